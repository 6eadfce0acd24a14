"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

A document's set has its distinct shingles of ``SHINGLE`` words.  Two documents
link when 100 * intersection >= 75 * union.  The components of these links are
exact; the links are not listed, and in groups of more than ``LARGE`` sets those
that would change no component are not all verified:

1. Frequencies.  One pass over all texts counts shingles in a fixed number of
   hashed counters.  A shingle's place in the global order is its counter's
   frequency class, then its hash: rare ones come first.  Any fixed order gives
   the same links; a good one gives few candidates.
2. Prefixes.  Linked sets share a shingle among the first n - ceil(0.75 n) + 1
   of each.  Equal sets are one set from here on: copies in a task send one
   prefix.  Shingles that one set alone has in its prefix drop out in a
   streaming pass over each partition; no group is held in memory.
3. Small groups.  Sets that share a prefix shingle are paired if their sizes
   allow a link and their common prefix shingles are enough for one.
4. Large groups: more than ``LARGE`` sets share the shingle, or its counter is so
   high that they might be too many for a task; such shingles are not dealt out
   by value at all.  Near copies have the same shingles, so a set takes part in
   the groups of its first ``FIRST`` such shingles only.  There it meets
   ``PIVOTS`` of the sets of its size.
5. Tries.  Candidates are verified in blocks: some sets, in the global order,
   form a prefix tree, stored as sorted sequences: the shared beginning of two
   neighbours is the path that they share.  Another set walks through it.  The
   traversal computes the overlap once for each shared path, and leaves a
   subtree when the overlap so far and the shorter remaining length can't reach
   a link.  A small group's set walks through the tree of its partners, a large
   group's sets walk through the tree of the pivots.
6. Components.  Links and copies give components by alternating star
   contractions on tables in the shared folder, few links by one task; the driver
   sees counts only.
7. Second round.  What still lies in different components of a large group meets
   in blocks inside the workers, by sizes, places and parity maps.  Where a set
   may link with more than ``NEAREST`` others of a group, the nearest ones are
   verified first and its component is joined to theirs, as then most others lie in
   its own component; at last all pairs that are left are verified.

Defined cases: null, empty and wordless texts have the empty set and link with
nothing.  Texts of fewer words than a shingle have one shingle, the whole
sequence.  Rows that share an id are one document with several texts.  Rows
without an id link with nothing; their component is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnql.llm import common

SHINGLE = 5
#: Hashed counters for the global order; their size in memory is fixed.
COUNTERS = 1 << 20
#: Counters travel in so many parts, so that tasks share the summing.
PARTS = 16
#: Sets that may share a prefix shingle and still be paired each with each.
LARGE = 32
#: Sets of a size that all others of a larger group meet at first, and groups of a set.
PIVOTS, FIRST = 16, 3
#: A counter is too high to deal its shingles out by value above so many times the mean, and above so many times ``LARGE``.
HIGH_MEAN, HIGH_LARGE = 8, 64
#: Tokens before a common one that tell whether it is the first.
BEFORE = 4
#: Places of sets that a task remembers, so that it sends each once.
SEEN = 100_000
#: Sets of a large group in a block, about.
WALKERS = 256
#: Partners of one candidate in a task, about.
PARTNERS = 64
#: Bits of the filter that spares a shuffle of texts without candidates.
FILTER_BITS = 1 << 23
#: Words of 64 bits in a set's parity map, and their columns.
MAP_WORDS = 4
MAPS = [f"map{i}" for i in range(MAP_WORDS)]
#: Sets outside a group's main component in a block of the second round, about, and pairs compared at once.
OUTSIDE, AT_ONCE = 1024, 1 << 18
#: Others of a group that a set is verified with before all that are left, and rounds of that.
NEAREST, NEAR_ROUNDS = 8, 2
#: Links whose components one task finds, 16 bytes each.
ONE_TASK = 50_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the texts' shingles, one text after the other, and each text's number of them."""
    words = [common.blank_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashes = common.remembered("shingles", lambda: common.Words(xxhash.xxh64_intdigest))
    h = np.fromiter((x for w in words for x in map(hashes.__getitem__, w)), np.uint64, int(n.sum()))
    counts = np.where(n == 0, 0, np.maximum(1, n - k + 1))
    first = np.repeat(np.cumsum(n) - n, counts)
    at = first + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.repeat(np.minimum(n, k), counts)
    out = length.astype(np.uint64)
    for i in range(k):
        here = length > i
        step = (out ^ h[np.minimum(at + i, max(len(h) - 1, 0))] if len(h) else out) * _MIX
        step ^= step >> np.uint64(29)
        out = np.where(here, step, out)
    return out, counts


def in_order(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Numbers whose order is the global order: the frequency class, then 56 bits of the hash."""
    return (classes[(hashes % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1 if n else 0


def needed(a: int, b: int) -> int:
    """The least intersection of linked sets of these sizes."""
    return -(-3 * (a + b) // 7)


def _set_key(ordered: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(ordered.tobytes()) - (1 << 63)


def parity_map(ordered: np.ndarray) -> np.ndarray:
    """Each bit tells whether an odd number of the set's tokens fall on it.

    Common tokens cancel out in the difference of two maps, so that it has at
    most as many bits as the sets have tokens that are not common.
    """
    odd = np.bincount((ordered % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


#: Texts to the hashes of their terms, one text after the other, and each text's number of them.
Terms = Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]]


def frequency_classes(docs: DataFrame, terms: Terms = shingles) -> np.ndarray:
    """A class from 0 to 255 for each counter, from the terms of all texts."""
    size = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in common.slices(batches, 0):
            h, _ = terms(common.texts(batch.column(0)))
            total += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(total[i * size : (i + 1) * size]) for i in range(PARTS)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + _unpacked(counts, size)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_classes(x).tobytes() for x in sums.values()], pa.binary())], names=["part", "classes"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, counts binary")
    with common.small_batches(docs.sparkSession):
        found = rows.repartition(PARTS, "part").mapInArrow(add, "part int, classes binary").collect()  # one byte for each counter
    out = np.zeros(COUNTERS, np.uint8)
    for r in found:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["classes"], np.uint8)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Numbers below 2^32, lowest bytes first and compressed: the high bytes are mostly zero."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)


def high_class(classes: np.ndarray, most: int) -> int:
    """The least class of counters that are too high to deal their shingles out by value."""
    mean = float((np.exp2(classes / 8.0) - 1).mean())
    return min(256, int(np.ceil(8 * np.log2(max(HIGH_MEAN * mean, HIGH_LARGE * most) + 1))))


def _sets(texts: list[bytes | None], classes: np.ndarray, terms: Terms) -> list[np.ndarray]:
    h, counts = terms(texts)
    return [np.unique(x) for x in np.split(in_order(h, classes), np.cumsum(counts)[:-1])] if texts else []


def prefixes(docs: DataFrame, classes, terms: Terms = shingles) -> DataFrame:
    """(doc_id, n, key, tokens, maps): each document's set, and its prefix and parity map if it is the task's first with this set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("tokens", pa.list_(pa.int64())), *((m, pa.int64()) for m in MAPS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.slices(batches, 1):
            ids, n, keys, tokens, maps = batch.column(0).to_pylist(), [], [], [], []
            for doc_id, s in zip(ids, _sets(common.texts(batch.column(1)), classes.value, terms), strict=True):
                key = _set_key(s)
                n.append(len(s))
                keys.append(key)
                if doc_id is None or not len(s) or key in seen:
                    tokens.append(None)
                    maps.append([None] * MAP_WORDS)
                else:
                    seen.add(key)
                    tokens.append(s[: prefix_length(len(s))].view(np.int64))
                    maps.append(parity_map(s).tolist())
            words = [pa.array([m[i] for m in maps], pa.int64()) for i in range(MAP_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), *words], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key long, tokens array<long>" + "".join(f", {m} long" for m in MAPS))


def candidates(entries: DataFrame, most: int = LARGE) -> DataFrame:
    """(a, b, na, nb, token, place) for each shared token, from (token, key, size) dealt and sorted by token, size and key.

    ``size`` has the set's size in its upper half and the token's place in the
    set in its lower one.  ``token`` is null for a pair of a small group.  A
    large group is not held in memory; each of its sets gives a row with itself,
    the token and its place.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("token", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def small(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal size
            # by size: partners of i are those up to 4/3 of its size
            to = np.searchsorted(n, 4 * n // 3, side="right")
            i = np.arange(len(n))
            many = np.maximum(to - i - 1, 0)
            left = np.repeat(i, many)
            right = left + 1 + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            pair(keys[left], keys[right], n[left], n[right])

        def pair(a, b, na, nb) -> None:
            swap = a > b
            add(np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb), None, None)

        def add(a, b, na, nb, token, place) -> None:
            nonlocal size
            if len(a):
                small = token is None
                parts.append((a, b, na, nb, np.full(len(a), 0 if small else token), np.zeros(len(a), np.int64) if small else place, np.full(len(a), small)))
                size += len(a)

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4], mask=cols[6]), pa.array(cols[5].astype(np.int32), mask=cols[6])], schema=schema)

        # the open group: its token, its rows until it has too many, and the key before
        token, keys, ns, places, large, last = None, [], [], [], False, None
        for batch in batches:
            t, k, packed = (batch.column(i).to_numpy() for i in range(3))
            n, place = packed >> 32, packed & 0xFFFFFFFF
            cut = np.flatnonzero(np.diff(t)) + 1
            lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
            # runs of one row inside a batch are tokens of one set; only a batch's ends may go on elsewhere
            worth = highs - lows > 1
            worth[0] = worth[-1] = True
            two = highs - lows == 2
            two[0] = two[-1] = False
            at = lows[two]
            at = at[(k[at] != k[at + 1]) & (3 * n[at + 1] <= 4 * n[at])]
            pair(k[at], k[at + 1], n[at], n[at + 1])
            worth &= ~two
            for lo, hi in zip(lows[worth].tolist(), highs[worth].tolist(), strict=True):
                if hi == lo:
                    continue
                if t[lo] != token:
                    if len(ns) and sum(map(len, ns)) > 1:
                        small(np.concatenate(keys), np.concatenate(ns))
                    token, keys, ns, places, large, last = t[lo], [], [], [], False, None
                kk, nn, pp = k[lo:hi], n[lo:hi], place[lo:hi]
                fresh = np.concatenate([[last is None or kk[0] != last], kk[1:] != kk[:-1]])  # copies lie side by side
                last = kk[-1]
                kk, nn, pp = kk[fresh], nn[fresh], pp[fresh]
                if not len(kk):
                    continue
                if not large and sum(map(len, ns)) + len(kk) > most:
                    kk, nn, pp = np.concatenate([*keys, kk]), np.concatenate([*ns, nn]), np.concatenate([*places, pp])
                    large, keys, ns, places = True, [], [], []
                if large:
                    add(kk, kk, nn, nn, token, pp)
                else:
                    keys.append(kk)
                    ns.append(nn)
                    places.append(pp)
            if size > 50_000:
                yield flush()
        if len(ns) and sum(map(len, ns)) > 1:
            small(np.concatenate(keys), np.concatenate(ns))
        if size:
            yield flush()

    return entries.mapInArrow(run, "a long, b long, na int, nb int, token long, place int")


def _may_link(shared: F.Column) -> F.Column:
    """Whether so many common prefix tokens leave a link of sets of sizes na and nb possible.

    The set whose prefix ends first has all its common ones among the other's
    prefix; what follows its prefix adds at most its remaining length.
    """
    rest = lambda n: F.ceil(F.col(n) * 3 / 4) - 1  # noqa: E731  n - prefix length
    return shared + F.greatest(rest("na"), rest("nb")) >= F.ceil((F.col("na") + F.col("nb")) * 3 / 7)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the text of its doc_id.

    A bitmap of fixed size, made of the ids' hashes, drops most other rows
    before the join deals texts out.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = wanted.select(bit("doc_id").alias("bit")).groupBy(F.shiftright("bit", 15).cast("int").alias("word")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bitmap"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.expr("(bit % 32768) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = docs.select("doc_id", "text").withColumn("bit", bit("doc_id")).withColumn("word", F.shiftright("bit", 15).cast("int")).join(F.broadcast(bits), "word").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return near.select("doc_id", "text").join(wanted, "doc_id")


def ordered_sets(blocks: DataFrame, classes, terms: Terms = shingles) -> DataFrame:
    """Blocks (x, y, salt, in_trie, key, text) with the key's set in the global order, eight bytes a token, highest first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T._parse_datatype_string("x long, y int, salt int, in_trie boolean, key long, tokens binary")
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, key, tokens = None, 0, b""
        seen: set[tuple] = set()
        for batch in common.slices(batches, 5):
            own, sets = [], []
            for t, *place in zip(common.texts(batch.column(5)), *(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if t != text:  # a text's blocks lie side by side
                    (s,) = _sets([t], classes.value, terms)
                    text, key, tokens = t, _set_key(s), s.astype(">u8").tobytes()
                # rows that share an id may have equal texts, and meet the keys of each other's texts too
                own.append(key == place[4] and tuple(place) not in seen)
                if own[-1]:
                    sets.append(tokens)
                    seen.add(tuple(place))
                if len(seen) > SEEN:
                    seen.clear()
            kept = batch.filter(pa.array(own, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array(sets, pa.binary())], schema=schema)

    return blocks.select("x", "y", "salt", "in_trie", "key", "text").mapInArrow(run, out)


def trie_overlaps(own: np.ndarray, partners: list[np.ndarray]) -> list[bool]:
    """Which of the partners, sorted in the global order, link with ``own``.

    Neighbours' shared beginning is a shared path of the prefix tree: its
    overlap is known from the neighbour before.
    """
    out: list[bool] = []
    path = np.empty(0, own.dtype)  # the path to the leaf or the pruned node before
    hits = np.zeros(1, np.int64)  # overlap at each depth of the path
    failed = -1, 0, 0  # depth of the node pruned last, its overlap, its own rest
    for s in partners:
        most = min(len(path), len(s))
        differ = np.flatnonzero(path[:most] != s[:most])
        depth = int(differ[0]) if len(differ) else most
        goal = needed(len(own), len(s))
        if 0 <= failed[0] <= depth and failed[1] + min(len(s) - failed[0], failed[2]) < goal:
            out.append(False)  # inside the pruned subtree
            continue
        hits = hits[: depth + 1]
        parts, overlap, linked = [hits], int(hits[-1]), True
        failed = -1, 0, 0
        at = depth
        while at < len(s):
            step = s[at : at + 64]
            place = np.searchsorted(own, step)
            member = own[np.minimum(place, len(own) - 1)] == step
            parts.append(overlap + np.cumsum(member))
            overlap = int(parts[-1][-1])
            at += len(step)
            rest = len(own) - int(np.searchsorted(own, step[-1], side="right"))
            if overlap + min(len(s) - at, rest) < goal:
                linked, failed = False, (at, overlap, rest)
                break
        hits = np.concatenate(parts)
        path = s[:at]
        out.append(linked and overlap >= goal)
    return out


def links(rows: DataFrame) -> DataFrame:
    """(a, b) of the sets that link, from (x, y, salt, in_trie, key, tokens): each walker through the trie of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, trie = None, [], []
        for batch in common.slices(batches, 5):
            one, two = [], []
            for x, y, salt, in_trie, key, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (x, y, salt) != block:
                    block, keys, trie = (x, y, salt), [], []
                s = np.frombuffer(tokens, ">u8").astype(np.uint64)
                if in_trie:
                    keys.append(key)
                    trie.append(s)
                else:
                    linked = [k for k, ok in zip(keys, trie_overlaps(s, trie), strict=True) if ok and k != key]
                    one += [min(key, k) for k in linked]
                    two += [max(key, k) for k in linked]
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

    return rows.repartition("x", "y", "salt").sortWithinPartitions("x", "y", "salt", F.desc("in_trie"), "tokens").mapInArrow(run, "a long, b long").distinct()


def pair_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of pairs: a walks through the trie of its partners, some of them in each block."""
    # stored, so that Spark can split a hot a in the join
    parts = common.stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")))
    tries = pairs.join(parts, "a").select(F.col("a").alias("x"), F.lit(-1).alias("y"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(True).alias("in_trie"), F.col("b").alias("key"))
    walkers = parts.select(F.col("a").alias("x"), F.lit(-1).alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("in_trie"), F.col("a").alias("key"))
    return tries.unionByName(walkers)


def pivot_blocks(members: DataFrame) -> DataFrame:
    """Blocks of large groups (token, key, n, place): sets of a size walk through the trie of the group's pivots of that size."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("place", "token"))
    size = F.floor(F.log(F.col("n")) / np.log(4 / 3) + 1e-9).cast("int")
    near = members.withColumn("nth", nth).filter(F.col("nth") <= FIRST).select(F.col("token").alias("x"), size.alias("y"), "key")
    # keys are hashes, so groups of the same sets have mostly the same pivots; Spark limits the rows before it deals them out
    first = near.withColumn("nth", F.row_number().over(Window.partitionBy("x", "y").orderBy("key"))).filter(F.col("nth") <= PIVOTS).drop("nth")
    parts = near.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / WALKERS).cast("int").alias("parts"))
    tries = first.join(parts, ["x", "y"]).select("x", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("in_trie"), "key")
    walkers = near.join(parts, ["x", "y"]).select("x", "y", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("in_trie"), "key")
    return tries.unionByName(walkers)


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (a, b) that one task holds."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each can reach, for the nodes of the edges (a, b).

    Alternating star contractions, each written to the shared folder; up to
    ``ONE_TASK`` edges are united by one task.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return near.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        return joined.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    now = common.stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(united, "node long, component long")
    while True:
        new = common.stored(small_star(large_star(now)))
        # a star forest is a fixed point
        changed = new.join(now, ["a", "b"], "left_anti").unionByName(now.join(new, ["a", "b"], "left_anti"))
        done = changed.isEmpty()
        common.dropped(now)
        now = new
        if done:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def labelled(components: DataFrame) -> DataFrame:
    """(key, label) of components' nodes, their smallest ones included."""
    inner = components.select(F.col("node").alias("key"), F.col("component").alias("label"))
    return inner.unionByName(components.select(F.col("component").alias("key"), F.col("component").alias("label"))).distinct()


def jaccard_components(docs: DataFrame, most: int = LARGE, terms: Terms = shingles) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; ``terms`` may give other sets than those of shingles."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = frequency_classes(rows, terms)
    high = high_class(order, most)
    classes = docs.sparkSession.sparkContext.broadcast(order)  # one byte for each counter
    full = common.stored(prefixes(rows, classes, terms))
    entries = full.filter("tokens is not null").select(F.posexplode("tokens").alias("place", "token"), "key", "n")
    is_high = F.shiftrightunsigned("token", 56) >= high
    dealt = entries.filter(~is_high).select("token", "key", (F.shiftleft("n", 32) + F.col("place")).alias("size")).repartition("token").sortWithinPartitions("token", "size", "key")
    found = common.stored(candidates(dealt, most).groupBy("a", "b", "token").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("place").alias("place"), F.count(F.lit(1)).alias("c")))
    in_large = found.filter("token is not null").select("token", F.col("a").alias("key"), F.col("na").cast("long").alias("n"), "place")
    members = in_large.unionByName(entries.filter(is_high).select("token", "key", "n", "place").distinct())
    members = common.stored(members)
    large = not members.isEmpty()
    if large:
        maps = common.stored(full.filter("tokens is not null").select("key", *MAPS).distinct().join(members.select("key").distinct(), "key"))
    table = common.stored(full.select("doc_id", "n", "key"))
    ids = common.stored(table.filter("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    counted = found.filter("token is null").withColumn("kept", _may_link(F.col("c")))
    del dealt, entries, in_large
    common.dropped(full)
    # what two sets share of large groups' tokens is not counted; the second round makes up for it
    blocks = pair_blocks(counted.filter("kept").select("a", "b"))
    if large:
        blocks = blocks.unionByName(pivot_blocks(members))
    # a document with several texts joins their sets
    texts = table.filter("doc_id is not null and n > 0").select("doc_id", "key")
    several = texts.groupBy("doc_id").agg(F.min("key").alias("b"), F.max("key").alias("most")).filter("b != most").select("doc_id", "b")
    several = texts.join(several, "doc_id").filter("key != b").select(F.col("key").alias("a"), "b")
    by_key = common.stored(labelled(components(_verified(rows, blocks, ids, classes, terms).unionByName(several))))
    if large:
        near = common.stored(_met(members, maps, by_key, NEAREST))
        for _ in range(NEAR_ROUNDS):
            if near.filter("more").isEmpty():
                break
            by_key = _moved(by_key, _verified(rows, pair_blocks(common.stored(near.select("a", "b").distinct())), ids, classes, terms))
            near = common.stored(_met(members, maps, by_key, NEAREST))
        else:
            near = _met(members, maps, by_key)
        second = _verified(rows, pair_blocks(common.stored(_second_round(members, near, by_key, counted))), ids, classes, terms)
        by_key = _moved(by_key, second)
    named = by_key.join(ids, "key")
    named = named.join(named.groupBy("label").agg(F.min("doc_id").alias("component")), "label").select("key", "component")
    reps = ids.withColumnRenamed("doc_id", "rep").join(named, "key", "left").select("key", F.coalesce("component", "rep").alias("component"))
    return (
        table.join(reps, "key", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))
    )


def _verified(rows: DataFrame, blocks: DataFrame, ids: DataFrame, classes, terms: Terms) -> DataFrame:
    """(a, b) of the set keys that link, of the blocks' candidates."""
    wanted = common.stored(blocks.join(ids, "key"))
    found = common.stored(links(ordered_sets(_texts_of(rows, wanted), classes, terms)))
    common.dropped(wanted)
    return found


def _moved(by_key: DataFrame, found: DataFrame) -> DataFrame:
    """(key, label) of sets, with components joined by the links (a, b)."""
    label = lambda c: found.join(by_key.select(F.col("key").alias(c), F.col("label").alias(f"label_{c}")), c, "left").select("a", "b", F.coalesce(f"label_{c}", c).alias(c * 2))
    between = label("a").join(label("b"), ["a", "b"]).select(F.col("aa").alias("a"), F.col("bb").alias("b"))
    over = labelled(components(between)).select(F.col("key").alias("label"), F.col("label").alias("last"))
    moved = by_key.join(over, "label", "left").select("key", F.coalesce("last", "label").alias("label"))
    alone = over.join(by_key, F.col("key") == over["label"], "left_anti").select(F.col("label").alias("key"), F.col("last").alias("label"))
    return common.stored(moved.unionByName(alone))


def _held(members: DataFrame, by_key: DataFrame) -> DataFrame:
    return members.join(by_key, "key", "left").withColumn("component", F.coalesce("label", "key")).drop("label")


def _met(members: DataFrame, maps: DataFrame, by_key: DataFrame, nearest: int | None = None) -> DataFrame:
    """(a, b, more): pairs of large groups that the links so far leave in different components, and that may still link.

    The first common token of a linked pair leaves both sets enough of their
    rest for a link, so the places of the token in both sets tell; where a token
    shortly before is common too, it is not the first.  The parity maps of linked
    sets differ in no more bits than the sets may have tokens that are not common,
    so of a group's sets that are alike, but not enough, few meet.  With
    ``nearest``, only so many pairs of a set and a group, those whose maps differ
    least; ``more`` tells that there are others.

    The pairs are made in the workers: a block has some of the sets outside the
    group's largest component, in memory, and all of the group's pass by.
    """
    lags = [f"before{i}" for i in range(BEFORE)]
    places = Window.partitionBy("key").orderBy("place")
    held = _held(members.select("*", *(F.lag("token", i + 1).over(places).alias(x) for i, x in enumerate(lags))), by_key)
    sizes = held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("token").agg(F.sum("size").alias("every"), F.max(F.struct("size", "component")).alias("m")).filter("every > m.size")
    main = main.select("token", F.col("m.component").alias("main"), F.ceil((F.col("every") - F.col("m.size")) / OUTSIDE).cast("int").alias("parts"))
    left = common.stored(held.join(main, "token").join(maps, "key"))
    columns = ["token", "salt", "walks", "outside", "key", "n", "place", "component", *lags, *MAPS]
    left = left.withColumn("outside", F.col("component") != F.col("main"))
    walkers = left.filter("outside").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("walks", F.lit(True))
    others = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("walks", F.lit(False))
    dealt = walkers.select(columns).unionByName(others.select(columns)).repartition("token", "salt").sortWithinPartitions("token", "salt", F.desc("walks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, walking, walkers = None, [], {}
        kept: list[tuple[np.ndarray, ...]] = []  # walker, other key, margin
        counts = np.zeros(0, np.int64)

        def trimmed() -> None:
            i, key, margin = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((key, margin, i))
            i, key, margin = i[order], key[order], margin[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) < nearest
            kept[:] = [(i[near], key[near], margin[near])]

        def made(p: np.ndarray, key: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, key)), pa.array(np.maximum(p, key)), pa.array(more)], names=["a", "b", "more"])

        def ended() -> Iterator[pa.RecordBatch]:
            if kept:
                trimmed()
                i, key, _ = kept[0]
                kept.clear()
                yield made(walkers["key"][i], key, counts[i] > nearest)

        for batch in batches:
            c = {x: batch.column(k) for k, x in enumerate(columns)}
            # tokens have a class above 0 as their upper byte, so 0 and 1 are none
            c |= {x: pc.if_else(c["walks"], pc.fill_null(c[x], 0), pc.fill_null(c[x], 1)) for x in lags}
            c = {x: v.to_numpy(zero_copy_only=False) for x, v in c.items()}
            c["before"], c["map"] = np.stack([c.pop(x) for x in lags], 1), np.stack([c.pop(x) for x in MAPS], 1)
            new = (np.diff(c["token"]) != 0) | (np.diff(c["salt"]) != 0) | (np.diff(c["walks"].astype(np.int8)) != 0)
            cut = np.flatnonzero(new) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                if (c["token"][lo], c["salt"][lo]) != block:
                    yield from ended()
                    block, walking, walkers = (c["token"][lo], c["salt"][lo]), [], {}
                if c["walks"][lo]:
                    walking.append({x: v[lo:hi].copy() for x, v in c.items()})
                    continue
                if not walking and not walkers:
                    continue  # no set outside fell on this block
                if walking:
                    walkers = {x: np.concatenate([v[x] for v in walking]) for x in c}
                    walking, counts = [], np.zeros(len(walkers["key"]), np.int64)
                step = max(1, AT_ONCE // len(walkers["key"]))
                for at in range(lo, hi, step):
                    o = {x: v[at : min(at + step, hi)] for x, v in c.items()}
                    i, j, margin = may_link(walkers, o)
                    if nearest is None:
                        # of two sets outside, each walks
                        once = ~o["outside"][j] | (walkers["key"][i] < o["key"][j])
                        if once.any():
                            yield made(walkers["key"][i[once]], o["key"][j[once]], np.zeros(int(once.sum()), bool))
                    elif len(i):
                        counts += np.bincount(i, minlength=len(counts))
                        kept.append((i, o["key"][j], margin))
                        if sum(len(x[0]) for x in kept) > AT_ONCE:
                            trimmed()
        yield from ended()

    return dealt.mapInArrow(run, "a long, b long, more boolean")


def may_link(p: dict[str, np.ndarray], q: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, margin): which sets of p and q may link that meet at one token, and by how many bits their maps differ more than they may (at most 0)."""
    n, m = p["n"][:, None], q["n"][None]
    both = 3 * (n + m)
    ok = (p["component"][:, None] != q["component"][None]) & (4 * n >= 3 * m) & (4 * m >= 3 * n) & (both <= 7 * (n - p["place"][:, None])) & (both <= 7 * (m - q["place"][None]))
    i, j = np.nonzero(ok)
    total = p["n"][i] + q["n"][j]
    margin = np.bitwise_count((p["map"][i] ^ q["map"][j]).view(np.uint64)).sum(1, dtype=np.int64) - (total + 2 * (-3 * total // 7))
    near = margin <= 0
    i, j, margin = i[near], j[near], margin[near]
    first = ~(p["before"][i][:, :, None] == q["before"][j][:, None, :]).any((1, 2))
    return i[first], j[first], margin[first]


def _second_round(members: DataFrame, near: DataFrame, by_key: DataFrame, counted: DataFrame) -> DataFrame:
    """(a, b): the pairs of large groups that may still link, and those of small groups.

    The latter were counted before, and were pruned only as their common large
    tokens were not; they are at most as many as either set has.
    """
    many = _held(members, by_key).groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    one, two = (many.select(F.col("key").alias(k), F.col("held").alias(f"held_{k}"), F.col("component").alias(f"component_{k}")) for k in "ab")
    pruned = counted.filter("not kept").join(one, "a").join(two, "b").filter("component_a != component_b")
    by_count = pruned.filter(_may_link(F.col("c") + F.least("held_a", "held_b"))).select("a", "b")
    return near.select("a", "b").unionByName(by_count).distinct()


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.read(spark, sf_dir, "documents"))
