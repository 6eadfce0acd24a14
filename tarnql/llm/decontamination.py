"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the training texts' token postings: each task turns its
documents into segments of about ``SEGMENT_BYTES`` of text, and a segment holds
its sorted terms and, by term, the sorted word positions.  A document's words
are numbered one after the other; a gap of one position parts documents, so no
phrase crosses them.  Building needs no shuffle, and the index is written to
the shared folder, where a lost executor doesn't take it away.

``search`` answers windows of test items from the index alone.  In a segment, a
window with an absent term is dropped at once.  For the others the list of the
rarest term, moved back by its place in the window, gives the candidate starts;
they are intersected with the lists of the other terms, rarest first, each
moved by its own place.  A proximity match is an occurrence of the window's first
term from which every other one has an occurrence in the same document at most
``SLACK`` words off its place.

The test items are taken in blocks of about ``BLOCK_BYTES`` of text; each block
is broadcast and searched in every segment, so a large benchmark costs passes
over the index and no memory.

Defined cases: null and wordless texts have no words, no windows and no hits.
Rows that repeat an id are searched each for itself; items that share an id
count as one.  A null item id is written as the empty text.  An empty benchmark
leaves all documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnql.llm import common

WINDOW = 10
#: Words by which a term of a proximity match may lie off its place.
SLACK = 2
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
#: Candidates that are intersected at once.
CANDIDATES = 1 << 20

_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("starts", pa.binary()), ("terms", pa.binary()), ("ends", pa.binary()), ("postings", pa.binary())])
INDEX = "doc_ids array<long>, starts binary, terms binary, ends binary, postings binary"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, lowest bytes first: the high bytes are mostly zero and compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def segment(doc_ids: list[int | None], texts: list[bytes | None]) -> dict:
    """The index of some documents."""
    words, starts, at = [], [], 0
    positions = []
    for text in texts:
        own = common.alnum_words(text)
        starts.append(at)
        positions.append(np.arange(at, at + len(own), dtype=np.int64))
        words += own
        at += len(own) + 1
    coded = pa.array(words, pa.binary()).dictionary_encode()
    terms = coded.dictionary
    order = pc.array_sort_indices(terms).to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    ids = rank[coded.indices.to_numpy()] if words else np.empty(0, np.int64)
    if len(terms) <= 1 << 16:
        ids = ids.astype(np.uint16)  # radix sort
    by_term = np.argsort(ids, kind="stable")
    ends = np.cumsum(np.bincount(ids, minlength=len(terms)))
    postings = (np.concatenate(positions) if positions else np.empty(0, np.int64))[by_term]
    # within a term, the differences
    gaps = np.diff(postings, prepend=0)
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(terms) else np.empty(0, np.int64)
    gaps[firsts] = postings[firsts]
    return {"doc_ids": doc_ids, "starts": _planes(np.array([*starts, at])), "terms": b" ".join(terms.take(pa.array(order)).to_pylist()), "ends": _planes(ends), "postings": _planes(gaps)}


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of all the documents, stored in the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        ids, texts, size = [], [], 0
        for batch in common.slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or b"")
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema=_INDEX)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema=_INDEX)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stored(rows.mapInArrow(run, INDEX).withColumn("segment", F.monotonically_increasing_id()))


def windows(items: list[tuple[str, bytes | None]], length: int = WINDOW) -> dict:
    """The items' windows as numbers of terms; -1 fills those of short items."""
    vocabulary: dict[bytes, int] = {}
    rows, owners, names = [], [], []
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in common.alnum_words(text)]
        if not ids:
            continue
        names.append(name)
        for i in range(max(1, len(ids) - length + 1)):
            part = ids[i : i + length]
            rows.append(part + [-1] * (length - len(part)))
            owners.append(len(names) - 1)
    return {"terms": list(vocabulary), "windows": np.array(rows, np.int64).reshape(-1, length), "owners": np.array(owners, np.int64), "names": names}


def _occurrences(query: dict, terms: pa.Array, ends: np.ndarray, postings: np.ndarray, starts: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start, document) of each match in a segment, some at a time."""
    rows = query["windows"]
    if not len(rows) or not len(terms):
        return
    place = pc.index_in(pa.array(query["terms"], pa.binary()), value_set=terms)
    place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    used = rows >= 0
    term = np.where(used, place[rows], 0)
    alive = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
    if not len(alive):
        return
    term, used = term[alive], used[alive]
    # one sorted key for each posting of the terms that the windows have
    wanted = np.unique(term[used])
    keys = np.concatenate([(t << 32) + postings[begins[t] : ends[t]] for t in wanted])
    frequency = np.where(used, (ends - begins)[term], np.iinfo(np.int64).max)
    order = np.argsort(frequency, axis=1, kind="stable")
    rarest = term[np.arange(len(alive)), order[:, 0]]
    amount = (ends - begins)[rarest]
    sums = np.cumsum(amount)
    at = 0
    while at < len(alive):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CANDIDATES, side="right")))
        part = np.arange(at, to)
        w = np.repeat(part, amount[part])
        first = np.repeat(begins[rarest[part]], amount[part])
        nth = np.arange(len(w)) - np.repeat(np.cumsum(amount[part]) - amount[part], amount[part])
        doc = np.searchsorted(starts, postings[first + nth], side="right") - 1
        start = postings[first + nth] - order[w, 0]
        if slack:  # the rarest term may be off its place too
            w, doc = np.repeat(w, 2 * slack + 1), np.repeat(doc, 2 * slack + 1)
            start = (start[:, None] + np.arange(-slack, slack + 1)).ravel()
        for k in range(order.shape[1]):
            column = order[w, k]
            here = used[w, column]
            goal = start + column
            base = term[w, column] << 32
            off = np.where(column == 0, 0, slack)
            # a document's last word lies two positions before the next one's start
            low, high = np.maximum(goal - off, starts[doc]), np.minimum(goal + off, starts[doc + 1] - 2)
            near = keys[np.minimum(np.searchsorted(keys, base + low), len(keys) - 1)]
            ok = ~here | ((near >= base + low) & (near <= base + high))
            w, start, doc = w[ok], start[ok], doc[ok]
            if not len(w):
                break
        if len(w):
            yield alive[w], start, doc
        at = to


def search_segment(query: dict, row: dict, slack: int = SLACK) -> dict:
    """For each document of a segment: words, hit positions, items and nearly matching items."""
    starts, ends, gaps = _from_planes(row["starts"]), _from_planes(row["ends"]), _from_planes(row["postings"])
    names = row["terms"].split(b" ") if row["terms"] else []
    postings = np.cumsum(gaps)
    if len(ends):
        firsts = np.concatenate([[0], ends[:-1]])
        postings -= np.repeat(postings[firsts] - gaps[firsts], ends - firsts)
    terms = pa.array(names, pa.binary())
    n = len(starts) - 1
    mark = np.zeros(starts[-1] + 1, np.int64)
    lengths = (query["windows"] >= 0).sum(axis=1)
    items: list[set[int]] = [set() for _ in range(n)]
    near: list[set[int]] = [set() for _ in range(n)]
    for into, allowed in ((items, 0), (near, slack)):
        for w, start, doc in _occurrences(query, terms, ends, postings, starts, allowed):
            if not allowed:
                np.add.at(mark, start, 1)
                np.add.at(mark, start + lengths[w], -1)
            for d, o in set(zip(doc.tolist(), query["owners"][w].tolist(), strict=True)):
                into[d].add(o)
    hit = np.flatnonzero(np.cumsum(mark) > 0)
    return {"n_words": np.diff(starts) - 1, "hits": np.split(hit, np.searchsorted(hit, starts[1:-1])) if n else [], "items": items, "near": near, "starts": starts}


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """A row for each document: doc_id, n_words, hits (word numbers), items and near_items (item ids as text)."""
    spark = index.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    schema = pa.schema([("segment", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def searched(block: int) -> DataFrame:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast(windows([(r["item_id"], None if r["text"] is None else r["text"].encode()) for r in part], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.forget()
            query = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                    got = search_segment(query, row, slack)
                    name = lambda sets: [sorted({query["names"][o] for o in s}) for s in sets]  # noqa: B023, E731
                    n = len(row["doc_ids"])
                    hits = [(h - s).astype(np.int32) for h, s in zip(got["hits"], got["starts"], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([row["segment"]] * n, range(n), row["doc_ids"], got["n_words"], hits, name(got["items"]), name(got["near"])), schema, strict=True)], schema=schema)

        return index.mapInArrow(run, "segment long, nth int, doc_id long, n_words long, hits array<int>, items array<string>, near_items array<string>")

    out = searched(0)
    for block in range(1, blocks):
        out = out.unionByName(searched(block))
    if blocks > 1:
        merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        out = out.groupBy("segment", "nth").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(merged(c).alias(c) for c in ("hits", "items", "near_items")))
    return out.drop("segment", "nth")


def report(found: DataFrame) -> DataFrame:
    """The digest of ``search``'s rows."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(common.read(spark, sf_dir, "documents"))
    return report(search(index, common.read(spark, sf_dir, "benchmark")))


def brute_force_near(docs: list[tuple], benchmark: list[tuple], length: int = WINDOW, slack: int = SLACK) -> dict:
    """doc_id -> ids of the items that match it nearly, start by start, for tests."""
    out = {}
    for doc_id, text in docs:
        places: dict[bytes, list[int]] = {}
        for p, w in enumerate(common.alnum_words(None if text is None else text.encode())):
            places.setdefault(w, []).append(p)
        found = set()
        for item_id, item in benchmark:
            ws = common.alnum_words(None if item is None else item.encode())
            for i in range(max(1, len(ws) - length + 1) if ws else 0):
                part = ws[i : i + length]
                if any(all(any(abs(p - s - k) <= slack for p in places.get(t, [])) for k, t in enumerate(part) if k) for s in places.get(part[0], [])):
                    found.add("" if item_id is None else str(item_id))
        out[doc_id] = sorted(found)
    return out


def brute_force(docs: list[tuple], benchmark: list[tuple], length: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256), window by window, for tests."""
    wanted: dict[tuple, set[str]] = {}
    for item_id, text in benchmark:
        ws = common.alnum_words(None if text is None else text.encode())
        for i in range(max(1, len(ws) - length + 1) if ws else 0):
            wanted.setdefault(tuple(ws[i : i + length]), set()).add("" if item_id is None else str(item_id))
    out = {}
    sizes = {len(w) for w in wanted}
    for doc_id, text in docs:
        ws = common.alnum_words(None if text is None else text.encode())
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (found := wanted.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        out[doc_id] = len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return out
