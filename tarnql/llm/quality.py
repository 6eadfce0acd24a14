"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are pairs of neighbouring characters, by class (lower-case
letters apart, capitals, digits, line ends and signs by kind), and terms for
the shares of words and lines that repeat the one before.  Latent semantic
analysis of at most ``MAX_LABELLED`` labelled texts gives the
projection.  The labelled vectors have a fixed bound, ``MAX_LABELLED`` times
``RANK`` numbers, and are broadcast.  Every document's cosines to all of them
are computed exactly, block by block; its ``NEIGHBOURS`` nearest vote, each
with its similarity as weight.

Defined cases: null and empty texts, and those of one byte, have no terms and
get the labelled rows' mean.  Without labelled rows every score is 0.5.  Rows
with equal ids are scored each by its own text.  Ties between neighbours (cosines
equal in ``DIGITS`` decimal places) go to the one first in the order of the sample.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

#: Labelled rows that the classifier is fitted on, at most.
MAX_LABELLED = 4000
RANK = 48
NEIGHBOURS = 15
#: Rows whose cosines are computed at once.
BLOCK = 256
#: Decimal places of a cosine; differences below them are rounding.
DIGITS = 5
#: Character classes: at most 64, so a pair has a 12-bit number.
CLASSES = 64
#: Terms for a share: a share of x is written as the first x * STEPS of them, STEP_COUNT times each.
STEPS, STEP_COUNT = 16, 100


def _classes() -> bytes:
    table = bytearray(256)
    signs = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    for b in range(256):
        if 97 <= b <= 122:
            table[b] = b - 97
        elif 65 <= b <= 90:
            table[b] = 26
        elif 48 <= b <= 57:
            table[b] = 27
        elif b >= 128:
            table[b] = 28
        elif b in (10, 13):
            table[b] = 29
        elif b in signs:
            table[b] = 31 + signs.index(b)
        else:
            table[b] = 30
    return bytes(table)


_TABLE = _classes()


def terms(texts: list[bytes | None]) -> np.ndarray:
    """Each text's pair counts, dampened."""
    out = np.zeros((len(texts), CLASSES * CLASSES), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text and len(text) > 1:
            a = np.frombuffer(text.translate(_TABLE), np.uint8)
            row[:] = np.bincount(a[:-1].astype(np.uint16) * CLASSES + a[1:], minlength=CLASSES * CLASSES)
            for at, units in ((len(row) - 2 * STEPS, text.split()), (len(row) - STEPS, text.split(b"\n"))):
                again = sum(map(eq, units, units[1:]))
                row[at : at + math.ceil(STEPS * again / max(1, len(units)))] = STEP_COUNT
    return np.log1p(out, out=out)


def fit(texts: list[bytes], labels: list[int], rank: int = RANK) -> dict:
    """The projection, the labelled vectors of length 1, and their labels."""
    x = terms(texts)
    df = (x > 0).sum(axis=0)
    idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) + 1
    norm = np.linalg.norm(x * idf, axis=1, keepdims=True)
    x = x * idf / np.maximum(norm, 1e-9)
    # subspace iteration from a fixed start finds the leading right singular vectors
    v = np.random.default_rng(0).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(6):
        v = np.linalg.qr(x.T @ (x @ v))[0]
    _, _, turn = np.linalg.svd(x @ v, full_matrices=False)
    v = v @ turn[:rank].T
    projection = (idf[:, None] * v).astype(np.float32)
    y = np.asarray(labels, np.float32)
    return {"projection": projection, "vectors": _unit(terms(texts) @ projection), "labels": y, "prior": float(y.mean())}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Marks each row's k largest cosines; of equal ones the first."""
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k, None]
    above, equal = cosines > least, cosines == least
    room = k - above.sum(axis=1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1) <= room))


def scores(model: dict | None, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Each text's vote for label 1, from 0 to 1."""
    if model is None:
        return np.full(len(texts), 0.5)
    out = np.full(len(texts), model["prior"])
    k = min(neighbours, len(model["labels"]))
    for at in range(0, len(texts), BLOCK):
        part = texts[at : at + BLOCK]
        cosines = np.round(_unit(terms(part) @ model["projection"]) @ model["vectors"].T, DIGITS)
        weight = np.where(nearest(cosines, k), np.maximum(cosines, 0), 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = weight @ model["labels"] / np.maximum(total, 1e-12)
        has = np.array([t is not None and len(t) > 1 for t in part]) & (total > 0)
        out[at : at + BLOCK][has] = np.clip(vote[has], 0, 1)
    return out


def held_out() -> F.Column:
    """Whether the row's labels must not be learnt from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict | None:
    """The model of at most ``most`` labelled rows that aren't held out, chosen by their id's hash."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(most)
    )
    rows = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(most)
        .select(F.col("text").cast("binary").alias("text"), "quality")
        .collect()
    )
    return fit([bytes(r["text"]) for r in rows], [r["quality"] for r in rows]) if rows else None


def score(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and the score of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: list[bytes | None]) -> dict:
        common.forget()
        return {column: scores(shared.value, texts)}

    return common.with_columns(docs, "text", scored, f"{column} double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
