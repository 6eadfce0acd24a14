"""A corpus pipeline: quality, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of docs.  Columns besides doc_id and text pass through unread; the
stages' own columns get names that docs doesn't have.

Every row is judged by itself: what it says, not which id it has.  The third and
fourth stage know a text by its 64-bit hash, so rows that share an id, or have
none, keep apart, and equal texts are searched once.

Nulls: a null text is scored, labelled and packed as an empty one (its language
is ``und``, so the second stage drops it).  Rows that are equal in all columns
are copies of one another, and the third stage keeps one of them.  Texts without
words have no copies: the third stage keeps them all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnql.llm import common, decontamination, jaccard_join, language, packing, quality

#: Least share of its best language below which a text is no text of any.
LEAST_LANGUAGE = 0.4
#: Bytes of chunks that a worker remembers in the last stage: less than in packing alone, as the stages before it leave a larger heap.
PACKING_MEMORY = common.MEMORY_BYTES // 4


def _fresh(docs: DataFrame, name: str) -> str:
    """The name, with as many marks as it takes to be new."""
    while name in docs.columns:
        name += "_"
    return name


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _on_small_heaps(stage: Callable) -> Callable:
    """The stage, begun after the JVMs have given back what the stage before left: heaps add up with the workers' memory."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.collected(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_on_small_heaps
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below 0.5."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    score = _fresh(docs, "quality_score")
    return quality.score(docs, model, score).filter(F.col(score) >= 0.5).drop(score)


@_on_small_heaps
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without a letter, or too mixed for any."""
    label, score = _fresh(docs, "lang_label"), _fresh(docs, "lang_score")
    found = language.identify(docs, language.train(docs), label, score)
    return found.filter((F.col(label) != "und") & (F.col(score) >= LEAST_LANGUAGE)).drop(label, score)


@_on_small_heaps
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of links: one with the smallest id, or if none has an id any.

    Of several such rows, the first by their columns' hash stays.
    """
    key, row = _fresh(docs, "text_key"), _fresh(docs, "row_hash")
    rows = docs.withColumn(key, _text_key()).withColumn(row, F.xxhash64(*docs.columns))
    found = jaccard_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    groups = common.stored(found.filter("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct())
    own = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("id"), F.col(row).alias("row")).join(groups, "key")
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "key")).alias("f"))
    kept = common.stored(first.select(F.col("f.key").alias(key), F.col("f.row").alias(row)))
    wordless = ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    nth = _fresh(docs, "nth")
    # rows that are equal in all columns have one key and hash
    copies = Window.partitionBy(key, row).orderBy(row)
    worded = rows.filter(~wordless).join(kept, [key, row]).withColumn(nth, F.row_number().over(copies)).filter(F.col(nth) == 1)
    return worded.select(*docs.columns).unionByName(docs.filter(wordless))


@_on_small_heaps
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of a benchmark item."""
    key = _fresh(docs, "text_key")
    rows = docs.withColumn(key, _text_key())
    found = decontamination.search(decontamination.build_index(rows.select(F.col(key).alias("doc_id"), "text")), common.read(spark, sf_dir, "benchmark"))
    dirty = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(dirty, key, "left_anti").select(*docs.columns)


@_on_small_heaps
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' tokens; a row for each piece."""
    return packing.pack(docs, packing.default_tokenizer(), memory=PACKING_MEMORY)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL for trained classifiers and tokenizers; ``test_chain_against_brute_force`` holds the chain against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is stored in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, common.stored(stage(spark, docs, sf_dir))
        if k:
            common.dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
