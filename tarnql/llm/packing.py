"""Packing of documents into sequences by best-fit decreasing.

A document's ids are the tokenizer's, then an end id.  Overlong documents are
first cut into full windows; every remaining piece is an item.  Items are
placed by decreasing length, each into the open window with the least
remaining capacity that still holds it; a segment tree indexed by remaining
capacity finds that window.

Only lengths matter to the placement, and there are at most ``capacity`` of
them.  So the driver packs the histogram of lengths: windows with the same
remaining capacity are moved in runs, with the result that placing the items
one by one would give.  Its work and memory are bounded by ``capacity``, not
by the number of documents.  Each item then finds its run by its rank among
the items of its length; ranks come from counts by block, so that no task
gathers all the items of a frequent length.

Defined cases: null text is empty and gives the end id alone.  Rows that repeat
an id are packed each for itself.  An empty table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnql.llm import common

CAPACITY = 2048
END_ID = 1
#: Pieces in a block, about; ranks are counted inside a block.
BLOCK_ROWS = 10_000
#: Characters whose unknown chunks are encoded together, about.
TOGETHER = 1 << 20
#: Bytes that the chunks' ids which a worker remembers take, about, and as many again that were last in use before those.
MEMORY = 2 * common.MEMORY_BYTES
#: Stands between chunks that are encoded together; texts with it, or with a
#: control character that only str.split() takes as a blank, are encoded whole.
MARK = "\x01"
WHOLE = (MARK, "\x1c", "\x1d", "\x1e", "\x1f")


class Encoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer never joins across white space.  So each chunk between white
    space is encoded once and remembered; unknown chunks are encoded together.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for text that is normalized already
        self.plain.normalizer = normalizers.Sequence([])
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.whole_only = (*WHOLE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.chunks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size, self.memory = 0, memory

    def whole(self, text: str) -> bytes:
        return self._ids(self.tokenizer, text).tobytes()

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.size > self.memory:
            self.chunks, self.before, self.size = {}, self.chunks, 0
        known, before = self.chunks, self.before
        cuts = [None if any(x in text for x in self.whole_only) else text.split() for text in texts]
        new = set().union(*filter(None, cuts)).difference(known)
        if before:
            again = {c for c in new if c in before}
            known.update({c: before[c] for c in again})
            self.size += 5 * sum(map(len, again)) + common.ENTRY_BYTES * len(again)
            new -= again
        # below U+0300 no character composes with another, and each is lower-cased by itself
        odd = {c for c in new if not c.isascii() and max(c) >= "\u0300"}
        self._learn(self.plain, list(new - odd), str.lower)
        self._learn(self.tokenizer, list(odd), str)
        for text, cut in zip(texts, cuts, strict=True):
            yield self.whole(text) if cut is None else b"".join(map(known.__getitem__, cut))

    def _learn(self, tokenizer, chunks: list[str], normal: Callable[[str], str]) -> None:
        if not chunks:
            return
        text = normal(f" {MARK} ".join(chunks))
        ids = self._ids(tokenizer, text)
        self.size += len(text) + 4 * len(ids) + common.ENTRY_BYTES * len(chunks)
        ends, packed, at = (4 * np.flatnonzero(ids == self.mark)).tolist(), ids.tobytes(), 0
        for c, end in zip(chunks, [*ends, len(packed)], strict=True):
            self.chunks[c] = packed[at:end]
            at = end + 4


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """A row for each piece: full windows, then what remains."""
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        for batch in common.slices(batches, 1):
            own = common.remembered(f"packing {tokenizer_path} {memory}", lambda: Encoder(tokenizer_path, memory))
            out: list[tuple] = []
            every = own.encode([text or "" for text in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), every, strict=True):
                ids += end
                n, step = len(ids) // 4, 4 * capacity
                out += [(doc_id, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]), n) for at in range(0, len(ids), step)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length int, ids_crc32 long, doc_tokens long")


class Capacities:
    """A segment tree over remaining capacities; it finds the least one in use that is at least x."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = [0] * (2 * self.size)

    def add(self, capacity: int, windows: int) -> None:
        at = self.size + capacity
        while at:
            self.used[at] += windows
            at //= 2

    def least(self, x: int) -> int | None:
        at = self.size + x
        while not self.used[at]:
            # up to the first subtree to the right, or to the end
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, items, items in a window, first window, offset), and the number of windows.

    Items of a run, by rank, fill consecutive windows, ``items in a window``
    in each, from ``offset`` on.
    """
    tree, open_, runs, windows = Capacities(capacity), {}, [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:  # new windows, as many as the items need or one that stays partly open
                each = min(capacity // length, left)
                n = left // each
                first, taken = windows, n
                windows += n
                room = capacity
            else:
                first, there = open_[room].pop()
                tree.add(room, -there)
                each = min(room // length, left)
                taken = min(there, left // each)
                if taken < there:
                    open_[room].append((first + taken, there - taken))
                    tree.add(room, there - taken)
            runs.append((length, rank, taken * each, each, first, capacity - room))
            left -= taken * each
            rank += taken * each
            if rest := room - each * length:
                open_.setdefault(rest, []).append((first, taken))
                tree.add(rest, taken)
    return runs, windows


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, memory: int = MEMORY) -> DataFrame:
    """Every piece with its sequence and its offset there; ``memory`` bounds the bytes a worker remembers of chunks, no results."""
    spark = docs.sparkSession
    pieces = common.stored(token_pieces(docs, tokenizer_path, capacity, end_id, memory))
    by_length = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs, _ = best_fit_decreasing({r["length"]: r["count"] for r in by_length}, capacity)
    blocks = max(1, sum(r["count"] for r in by_length) // BLOCK_ROWS)
    order = ["doc_id", "start", "doc_tokens", "ids_crc32"]
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("block", "length").count().select("block", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = (
        pieces.withColumn("n", F.row_number().over(Window.partitionBy("block", "length").orderBy(*order)))
        .join(firsts, ["block", "length"])
        .withColumn("rank", F.col("first") + F.col("n") - 1)
    )
    placed = spark.createDataFrame(runs, "length int, from_rank long, items long, each int, window long, at int")
    # the runs' number is bounded by ``capacity``
    return (
        ranked.join(F.broadcast(placed), "length")
        .filter((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("items")))
        .withColumn("k", F.col("rank") - F.col("from_rank"))
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("window") + F.expr("k div each")).alias("sequence_id"),
            (F.col("at") + F.col("k") % F.col("each") * F.col("length")).cast("long").alias("offset"),
        )
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"), default_tokenizer())
