"""Document fingerprints by SpotSigs.

A common word (an anchor) and the chain of content words after it form a spot
signature.  A document's fingerprint is its set of signatures; near duplicates
have a high Jaccard likeness of these sets, 0.75 or more.

``near_classes`` finds them for all documents, with the machinery of the n-gram
Jaccard join on signatures instead of shingles: sets that share a rare signature
are partitioned by their size, as only neighbouring sizes can be alike enough;
signatures that many share are split and meet pivots of their size; and each
comparison is pruned as soon as what both sets have left rules it out.
``near_pairs`` lists the pairs themselves, for tables without hot signatures.

Defined cases: null text is the empty text.  A text without signatures gets
one that stands for the whole text, so equal texts always have likeness 1.
Documents with equal ids are ordered by their text's hash.  A null id comes
before all others, and has no near class; rows that share an id have one class.
A single document is its own next document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common, jaccard_join

#: Common words of English, German, French and Spanish; fixed values.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "the of and to in a is that it for was on are as with be by this from at or not "
        "der die das und ein eine den zu von ist mit auf nicht sich des dem "
        "le la les de des et un une du en est que qui dans pour pas sur au "
        "el los las y del una por con para no se su es al lo"
    ).split()
)
#: Content words in a chain.
CHAIN = 2


def signatures(text: bytes, anchors: frozenset[bytes] = ANCHORS, chain: int = CHAIN) -> frozenset[int]:
    """32-bit hashes of the text's spot signatures, or of the whole text if it has none."""
    words = common.alnum_words(text)
    content: list[bytes] = []
    spots: list[tuple[int, bytes]] = []
    for w in words:
        if w in anchors:
            spots.append((len(content), w))
        else:
            content.append(w)
    last, digest = len(content) - chain, xxhash.xxh32_intdigest
    found = frozenset(digest(b" ".join((w, *content[at : at + chain]))) for at, w in spots if at <= last)
    return found or frozenset((digest(text),))


def encode(found: frozenset[int]) -> str:
    """The sorted signatures, eight hex digits each."""
    return b"".join(x.to_bytes(4, "big") for x in sorted(found)).hex()


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard likeness; 0 without a comparison where the sizes rule out ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large or small < least * large:
        return 0.0
    both = len(a & b)
    return both / (small + large - both)


def edited(text: bytes, following: bytes) -> bytes:
    """The last floor(n/2) code points of the text replaced by as many of the next one's first."""
    own = text.decode("utf-8", "surrogatepass")
    n = len(own) // 2
    # a code point has at most four bytes, so the cut needs no more of the next text
    head = following[: 4 * n + 4].decode("utf-8", "ignore")[:n]
    return (own[: len(own) - n] + head).encode("utf-8", "surrogatepass")


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' signatures, one text after the other, and each text's number of them."""
    found = [signatures(t or b"") for t in texts]
    hashes = np.fromiter((x for s in found for x in s), np.uint64, sum(map(len, found)))
    # the join's order takes counters from the low bits and keeps the others
    return hashes << np.uint64(32) | hashes, np.array([len(s) for s in found], np.int64)


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, near_class): the smallest doc_id that each document reaches by likenesses of 0.75 or more; rows without an id have none."""
    found = jaccard_join.jaccard_components(docs, terms=terms)
    return found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("near_class"))


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long"


def _row(doc_id: int | None, near_class: int | None, text: bytes, own: frozenset[int], following: bytes, other: frozenset[int]) -> tuple:
    new = edited(text, following)
    changed = own if new == text else signatures(new)
    n_chars = len(text) - sum(map(text.count, _CONTINUATION)) if not text.isascii() else len(text)
    return doc_id, n_chars, hashlib.sha256(new).hexdigest(), encode(own), encode(changed), likeness(own, changed), likeness(own, other), near_class


_CONTINUATION = [bytes([b]) for b in range(0x80, 0xC0)]


#: Bounds between blocks, and the ids on which several of them fall; both in order.
Cuts = tuple[list[int], list[int]]


def _parts(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cuts(docs: DataFrame) -> Cuts:
    """Quantiles of the ids, a bounded number for each partition; all that deals rows out to blocks shares one answer, as quantiles are approximate."""
    n = _parts(docs.sparkSession)
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 10_000)).first()[0] or []
    return sorted(set(got)), sorted({x for x, y in zip(got, got[1:]) if x == y})


def _blocks(docs: DataFrame, classes: DataFrame | None = None, cuts: Cuts | None = None) -> DataFrame:
    """(block, doc_id, hash, text, near_class): blocks are ranges of ids, in order.

    Null ids, and an id that has so many rows that several quantiles fall on it,
    are split into ranges of the texts' hashes, by which such rows are ordered.
    A row without a text and hash tells its id's class, in each of the id's blocks.
    """
    n = _parts(docs.sparkSession)
    bounds, heavy = cuts or _cuts(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block = F.when(F.col("doc_id").isNull(), -1).otherwise(_search("doc_id", bounds)) * (n + 1)
    share = F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * n), F.lit(n - 1))
    # a heavy id is the last one of its block
    part = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(heavy), share + 1).otherwise(0)
    texts = rows.withColumn("hash", F.xxhash64("text")).select((block + part).cast("int").alias("block"), "doc_id", "hash", "text", F.lit(None).cast("long").alias("near_class"))
    if classes is None:
        return texts
    parts = F.explode(F.when(F.col("doc_id").isin(heavy), F.sequence(F.lit(1), F.lit(n))).otherwise(F.array(F.lit(0)))).alias("part")
    told = classes.select("doc_id", "near_class", parts).select((block + F.col("part")).cast("int").alias("block"), "doc_id", F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("text"), "near_class")
    return texts.unionByName(told)


def _search(name: str, bounds: list[int]) -> F.Column:
    """How many bounds lie below the id: a binary search, of one size in the plan for any number of bounds."""
    if not bounds:
        return F.lit(0)
    # two literals, which Spark folds into arrays once: a plan has the search in many places
    among = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.split(F.lit(",".join(str(1 << k) for k in reversed(range(len(bounds).bit_length())))), ",").cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(among, low + step - 1) < F.col(name), low + step).otherwise(low))


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """(row, next row) for neighbours in a block; rows are (block, doc_id, near_class, text)."""
    before, told = None, (None, None)
    for batch in batches:
        for block, doc_id, near_class, text in zip(*(batch.column(k).to_pylist() for k in range(3)), common.texts(batch.column(3)), strict=True):
            if text is None:
                told = doc_id, near_class
                continue
            row = block, doc_id, told[1] if doc_id is not None and told[0] == doc_id else None, text
            if before is not None and before[0] == block:
                yield before, row
            before = row


def fingerprint(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, their likeness, and its class of near duplicates.

    One shuffle brings each range of ids into order, together with the ids'
    classes.  All rows but the last of a range meet the next document there; the
    ranges' first and last rows, two for each range, meet in a small join.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("near_class", pa.int64())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        seen: tuple[bytes, frozenset[int]] | None = None
        for (_, doc_id, near_class, text), (_, _, _, following) in _within(common.slices(batches, 3)):
            own = seen[1] if seen is not None and seen[0] == text else signatures(text)
            seen = following, (own if following == text else signatures(following))
            out.append(_row(doc_id, near_class, text, own, following, seen[1]))
            if len(out) >= common.SLICE_ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, near_class, text, following in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch.column(2)), common.texts(batch.column(3)), strict=True):
                own = signatures(text)
                out.append(_row(doc_id, near_class, text, own, following, own if following == text else signatures(following)))
            yield made(out)

    classes = common.stored(near_classes(docs))
    common.collected(docs.sparkSession)  # the join's plans and broadcasts are done with
    cuts = _cuts(docs)
    rows = _blocks(docs, classes, cuts)
    base = rows.repartition("block").sortWithinPartitions("block", "doc_id", "hash", "text").select("block", "doc_id", "near_class", "text")
    met = common.stored(_ends(_blocks(docs, cuts=cuts)).select("doc_id", "text", "following"))
    # two rows for each block at most
    of_ends = classes.join(F.broadcast(met.select("doc_id").distinct()), "doc_id")
    met = met.join(F.broadcast(of_ends), "doc_id", "left").select("doc_id", "near_class", "text", "following")
    return base.mapInArrow(inner, FIELDS).unionByName(met.mapInArrow(joined, FIELDS))


def _ends(rows: DataFrame) -> DataFrame:
    """(doc_id, text, following): each block's last document and the next block's first one.

    The blocks' number is bounded by the shuffle partitions', so their ends'
    ids are broadcast; texts with one id are ordered by hash, then by text.
    """
    ends = common.stored(rows.groupBy("block").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")))
    blocks = sorted(r["block"] for r in ends.select("block").collect())
    at = F.struct("hash", "text")
    near = rows.join(F.broadcast(ends), "block")
    lasts = near.filter(F.col("doc_id").eqNullSafe(F.col("last_id"))).groupBy("block", "doc_id").agg(F.max(at).alias("at"))
    firsts = near.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("block").agg(F.min(at).alias("at"))
    after = rows.sparkSession.createDataFrame(list(zip(blocks, blocks[1:] + blocks[:1])), "block int, after int")
    return (
        lasts.select("block", "doc_id", F.col("at.text").alias("text"))
        .join(after, "block")
        .join(firsts.select(F.col("block").alias("after"), F.col("at.text").alias("following")), "after")
    )


def members(prints: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents of equal fingerprints form a class, named by its smallest doc_id."""
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return prints.select("doc_id", "fingerprint").join(classes, "fingerprint").select("doc_id", "class_id")


def near_pairs(prints: DataFrame, least: float = 0.75) -> DataFrame:
    """(doc_a, doc_b, likeness) of classes whose fingerprints are at least this alike; ``members`` has the classes' documents.

    ``prints`` has doc_id and fingerprint.  Equal fingerprints form one class,
    named by its smallest doc_id, so a group of copies takes part once.  Sets
    are partitioned by size: bounds grow by 1/least, so a pair lies in one
    partition or in two neighbouring ones.  Inside a partition a pair is found
    through the first signatures of both sets, in one order for all and no more
    of them than the Jaccard bound asks for, and compared under the size bound.
    A signature that many different texts share makes as many pairs to compare.
    """
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    size = F.length("fingerprint") / 8
    part = F.floor(F.log(size) / math.log(1 / least) + 1e-9).cast("int")
    sets = classes.select("doc_id", "fingerprint", size.cast("int").alias("n"), part.alias("part"))
    keep = F.col("n") - F.ceil(F.col("n") * least) + 1
    sigs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("fingerprint", i * 8 + 1, 8))
    entries = sets.select("doc_id", "n", "part", F.explode(F.slice(sigs, F.lit(1), keep.cast("int"))).alias("sig"))
    a, b = entries.alias("a"), entries.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))).alias("b")
    pairs = (
        a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")))
        .filter((F.col("a.doc_id") != F.col("b.doc_id")) & (F.col("b.n") <= F.col("a.n")) & (F.col("b.n") >= F.col("a.n") * least))
        .select(F.least("a.doc_id", "b.doc_id").alias("doc_a"), F.greatest("a.doc_id", "b.doc_id").alias("doc_b"))
        .distinct()
    )
    one = sets.select(F.col("doc_id").alias("doc_a"), sigs.alias("x"))
    two = sets.select(F.col("doc_id").alias("doc_b"), sigs.alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "doc_a")
        .join(two, "doc_b")
        .select("doc_a", "doc_b", (both / (F.size("x") + F.size("y") - both)).alias("likeness"))
        .filter(F.col("likeness") >= least)
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.read(spark, sf_dir, "documents"))
