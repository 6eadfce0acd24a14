"""Helpers that the text operators share.

Words.  ``alnum_words`` and ``blank_words`` work on UTF-8 bytes: one table
look-up lower-cases A-Z and turns each separator into a blank, one split cuts
the words.  Bytes from 0x80 are never separators, so code points stay whole.

Shared tables.  ``stored`` cuts a lineage by writing a Parquet table below
``spark.checkpoint.dir``, which all executors see; a lost executor then costs
only its running tasks.  ``dropped`` deletes such tables after their last
reader.

Memory.  Spark's Arrow batches are bounded by its own setting, which only
``stored`` lowers, while it writes; ``slices`` cuts them to a few megabytes of text, whatever the rows hold.
What a worker remembers from batch to batch is bounded in bytes, and a worker
keeps the memory of one operator only (``remembered``); operators without one
call ``forget``, so that none of them runs beside another's memory.  A JVM's heap
grows to its bound and stays there; ``collected`` has it shrink to what is in use.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnql.sources.shared import shared_dir

#: Rows and bytes of text that a worker takes at once, about; a longer text is taken alone.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20
#: Spark's bound of the bytes that go to a Python worker at once.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that one operator's memory of words takes in a worker, about, and those of an entry besides the word.
MEMORY_BYTES, ENTRY_BYTES = 48 << 20, 160


def _table(keep: Callable[[int], bool]) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


#: Words are digits, letters and bytes from 0x80; everything else separates.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Only blank, tab, line feed, vertical tab, form feed and return separate.
BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return _cut(text, ALNUM)


def blank_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return _cut(text, BLANK)


def _cut(text: bytes | None, table: bytes) -> list[bytes]:
    # bytes.split() takes only 0x20 and 0x09-0x0D as blanks
    return text.translate(table).split() if text else []


def texts(column: pa.Array) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark hands Python workers batches of ``SLICE_BYTES``, about; afterwards of what it was set to.

    Meant for one write: a batch of Spark's own size lies in the JVM and in the
    worker at once, and ``slices`` would cut it only there.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read from there."""
    path = shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, after their last reader.

    Shuffle files of plans that nobody holds any more go with the driver's next
    garbage collection, so one is asked for.
    """
    gc.collect()
    for df in tables[:1]:
        df.sparkSession._jvm.System.gc()
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = hadoop(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def collected(spark: SparkSession) -> None:
    """Has the driver's and the executors' JVMs collect their garbage, and give back the heap that they don't use.

    A task for each core; an executor that gets none keeps its heap as it is.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows and by the bytes of a text column."""
    for batch in batches:
        if batch.num_rows <= SLICE_ROWS and batch.nbytes <= SLICE_BYTES:
            yield batch
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = (int(ends[at - 1]) if at else 0) + SLICE_BYTES
            to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


_memory: list = []


def remembered(key: str, make: Callable[[], Any]) -> Any:
    """What this worker remembers under the key; what it remembered under another key is let go first."""
    if not _memory or _memory[0] != key:
        forget()
        _memory.extend((key, make()))
    return _memory[1]


def forget() -> None:
    """Lets go what this worker remembers, and gives the memory back to the system."""
    if not _memory:
        return
    _memory.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)


class Words(dict):
    """Values by word, found once by ``find``; emptied when it takes more than ``most`` bytes, about."""

    def __init__(self, find: Callable[[bytes], Any], most: int = MEMORY_BYTES):
        super().__init__()
        self.find, self.most, self.size = find, most, 0

    def __missing__(self, word: bytes) -> Any:
        if self.size > self.most:
            self.clear()
            self.size = 0
        self.size += len(word) + ENTRY_BYTES
        found = self[word] = self.find(word)
        return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_columns(df: DataFrame, source: str, fn: Callable[[list], dict], new: str) -> DataFrame:
    """``df`` and the columns that ``fn`` makes of the UTF-8 texts in ``source``.

    All rows and columns pass through one Arrow stage: no shuffle and no join.
    A column that has a new one's name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fresh = T._parse_datatype_string(new)
    df = df.drop(*(set(fresh.names) - {source}))
    out = T.StructType(df.schema.fields + fresh.fields)
    arrow, made, at = to_arrow_schema(out), to_arrow_schema(fresh), df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            got = fn(texts(batch.column(at)))
            arrays = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(got[f.name], type=f.type, from_pandas=False) for f in made)], schema=arrow)

    return df.mapInArrow(run, out)
