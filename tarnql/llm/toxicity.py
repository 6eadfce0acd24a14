"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all
ordered thresholds.  A text's features are its distinct words and their
beginnings.  The labels only say toxic or not, so no severity is learnt from
people's judgement: the grades of toxic training texts are terciles of their
number of different words that mark toxicity: 1 mild, 2 strong, 3 severe; 0 is
clean.  The expected severity is the sum over
k of P(grade > k).

The model is fitted on at most ``MAX_LABELLED`` rows and keeps at most
``MAX_FEATURES`` features, so its broadcast is bounded; every text is then
scored whole.

Defined cases: null, empty and wordless texts have no features, so they get
the base rates.  Without labelled rows, or without toxic ones, every text is
clean.  Repeated rows are scored each.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 6000
MAX_FEATURES = 512
#: Lengths of the beginnings, in bytes.
PREFIXES = (3, 4, 5, 6)
#: Least rows with a feature (of few toxic rows a third, two at least), and its least excess over the base rate in standard errors.
LEAST_ROWS, LEAST_Z = 16, 6.0
GRADES = 4
STEPS, RATE, DECAY = 500, 0.05, 1e-6


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked apart."""
    return [word, *(word[:n] + b"-" for n in PREFIXES if len(word) >= n)]


def fit(texts: list[bytes], toxic: list[int]) -> dict | None:
    """Weights by feature, and the thresholds."""
    # copies would count as evidence again and again
    texts, toxic = zip(*dict(zip(texts, toxic, strict=True)).items(), strict=True) if texts else ((), ())
    y = np.asarray(toxic, bool)
    if not y.any() or y.all():
        return None
    total, with_toxic = Counter(), Counter()
    for text, t in zip(texts, y, strict=True):  # one text's features at a time
        own = {f for w in set(common.alnum_words(text)) for f in features(w)}
        total.update(own)
        if t:
            with_toxic.update(own)
    base = y.mean()
    least = min(LEAST_ROWS, max(2, int(y.sum()) // 3))
    z = {f: (with_toxic[f] - n * base) / np.sqrt(n * base * (1 - base)) for f, n in total.items() if n >= least}
    ranked = sorted(z, key=lambda f: (-z[f], f))
    # of few toxic rows no feature may stand out so far; then those that stand out most serve
    names = [f for f in ranked if z[f] >= LEAST_Z][:MAX_FEATURES] or [f for f in ranked if z[f] > 0 and z[f] == z[ranked[0]]][:MAX_FEATURES]
    if not names:
        return None
    column = {f: i for i, f in enumerate(names)}
    x, hits = np.zeros((len(texts), len(names))), np.zeros(len(texts))
    for i, text in enumerate(texts):
        for w in set(common.alnum_words(text)):
            own = [column[f] for f in features(w) if f in column]
            x[i, own] += 1
            hits[i] += bool(own)
    grade = np.where(y, 1 + np.searchsorted(np.quantile(hits[y], [1 / 3, 2 / 3]), hits), 0)
    # most texts have no marking word: equal rows are fitted once, with their number
    rows, amounts = np.unique(np.hstack([x, grade[:, None]]), axis=0, return_counts=True)
    weights, thresholds = _fit_ordinal(rows[:, :-1], rows[:, -1].astype(int), amounts)
    return {"weights": dict(zip(names, weights.tolist(), strict=True)), "thresholds": thresholds.tolist()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _fit_ordinal(x: np.ndarray, grade: np.ndarray, amounts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the mean negative log likelihood; thresholds are a first one and positive gaps.

    ``amounts`` tells how many rows each row stands for.
    """
    m, k = x.shape[1], GRADES - 1
    amounts = np.ones(len(x)) if amounts is None else amounts
    n = amounts.sum()
    p = np.zeros(m + k)
    p[m] = 1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        gaps = np.exp(p[m + 1 :])
        cut = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = x @ p[:m]
        low = np.where(grade > 0, cut[np.maximum(grade - 1, 0)], -np.inf)
        high = np.where(grade < k, cut[np.minimum(grade, k - 1)], np.inf)
        below, above = _sigmoid(low - s), _sigmoid(high - s)
        like = np.maximum(above - below, 1e-12)
        d_high, d_low = amounts * above * (1 - above) / like, amounts * below * (1 - below) / like
        d_cut = np.bincount(np.minimum(grade, k - 1)[grade < k], -d_high[grade < k], k) + np.bincount(np.maximum(grade - 1, 0)[grade > 0], d_low[grade > 0], k)
        grad = np.empty_like(p)
        grad[:m] = x.T @ (d_high - d_low) / n + DECAY * p[:m]
        grad[m] = d_cut.sum() / n
        grad[m + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * gaps / n
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        p -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])


class Scorer:
    """Weighted sums over texts' distinct words; remembers each word's weight."""

    def __init__(self, model: dict | None):
        self.model = model
        get = model["weights"].get if model else None
        self.known = common.Words(lambda word: sum(get(f, 0.0) for f in features(word)))

    def __call__(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        n = len(texts)
        s = np.zeros(n)
        if self.model is None:
            return {"above": np.zeros((n, GRADES - 1))}
        known = self.known
        for i, text in enumerate(texts):
            s[i] = sum(map(known.__getitem__, sorted(set(common.alnum_words(text)))))
        return {"above": _sigmoid(s[:, None] - np.array(self.model["thresholds"]))}


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, where: F.Column | None = None) -> dict | None:
    """The model of at most ``most`` labelled rows, chosen by their id's hash."""
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.filter(where)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    rows = (
        docs.select("doc_id", "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(most)
        .select(F.col("text").cast("binary").alias("text"), "toxic")
        .collect()
    )
    return fit([bytes(r["text"]) for r in rows], [r["toxic"] for r in rows]) if rows else None


def severity(docs: DataFrame, model: dict | None) -> DataFrame:
    """All rows and columns of ``docs``, with expected_severity, severity and toxic."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def each(texts: list[bytes | None]) -> dict:
        above = common.remembered(key, lambda: Scorer(shared.value))(texts)["above"]
        grades = -np.diff(np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))]), axis=1)
        return {
            "expected_severity": above.sum(axis=1),
            "severity": np.where(above[:, 0] >= 0.5, 1 + grades[:, 1:].argmax(axis=1), 0),
            "toxic": above[:, 0] >= 0.5,
        }

    return common.with_columns(docs, "text", each, "expected_severity double, severity int, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, train(docs, common.read(spark, sf_dir, "labels"))).drop("text")
