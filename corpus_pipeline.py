"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), docs being what the stage before it returned, written as Parquet and read again. All but
the last return the columns of ``documents``. A row is known by doc_id and a hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, jaccard, kdtree, language_id, mixing
from corpusflow.llm.common import Scratch, checked_join, columns_or_null, fold_of
from corpusflow.scratch import closed_after

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
KEY = ["doc", "text_key"]
#: Bytes of an Arrow batch, exceeded by a row at most. Of Spark's own 64 MB, each task holds several in the JVM and in Python.
BATCH_BYTES = 2 << 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with the session's Arrow batches held to BATCH_BYTES; a smaller bound is kept. As a result is worked out
    after the stage returns, the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and the key, which is never null."""
    return columns_or_null(docs, **COLUMNS).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("text_key", F.xxhash64("text"))


def _key_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))


def _once(keyed: DataFrame, each: str = "false") -> DataFrame:
    """One row of each key, but all rows where ``each`` holds. Of rows that differ in other columns the least (lang, source, n_chars) stays.

    Rows are shuffled with their texts only if some key is there more than once.
    """
    if keyed.filter(f"not ({each})").groupBy(*KEY).count().filter("count > 1").limit(1).count():
        rest = [c for c in keyed.columns if c not in (*KEY, "doc_id", "text")]
        nth = keyed.withColumn("nth", F.when(F.expr(each), F.monotonically_increasing_id()))
        one = nth.groupBy(*KEY, "nth").agg(F.min(F.struct(*rest)).alias("least"), F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        return one.select(*KEY, "doc_id", "text", "least.*")
    return keyed


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with more probability than the others together, go.

    Null and empty texts go. Repeated rows are judged alike, each stays or goes. Without a row to learn from all go. Of two languages
    with equal scores none has more than a half, so the document goes. An empty table stays empty; extra columns are dropped.
    """
    rows = columns_or_null(docs, **COLUMNS)
    model = language_id.train(rows.filter(fold_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return language_id.identify(rows, model, tuple(COLUMNS)).filter("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


@in_small_batches
def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least doc_id stays (nulls last, then by text hash).

    Documents without words are in no component: each of their rows stays, repeated ones too.
    """
    scratch = Scratch(spark, "pipeline")
    found = jaccard.join_components(docs)
    first = found.filter("component_key is not null").groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
    alone = found.filter("component_key is null").select("doc_id", "text_key", F.lit(True).alias("alone")).distinct()
    kept = first.select("kept.doc_id", "kept.text_key", F.lit(False).alias("alone")).union(alone)
    # distinct by key: a null id has the key of the least long
    keys = _key_of(kept).groupBy(*KEY).agg(F.max("alone").alias("alone"))
    rows = _once(checked_join(_keyed(docs), scratch.table(keys), KEY, row_bytes=49), "alone")
    return rows.select(*COLUMNS)


@in_small_batches
def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty table or benchmark changes nothing.
    """
    scratch = Scratch(spark, "pipeline")
    keyed = _keyed(docs)
    leaks = decontaminate.find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_columns=tuple(KEY)).select(*KEY).distinct()
    return checked_join(keyed, scratch.table(leaks), KEY, "left_anti", row_bytes=48).select(*COLUMNS)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words are never taken. Repeated rows share what the mix takes of them: as many rows stay as it takes in all,
    with the least lang, source and n_chars of them. An empty table stays empty.
    """
    scratch = Scratch(spark, "pipeline")
    taken = mixing.mix_sources(docs).filter("taken > 0").groupBy("doc_id", "text_key").agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"))
    rows = checked_join(_once(_keyed(docs)), scratch.table(_key_of(taken).select(*KEY, "copies")), KEY, row_bytes=56)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


@in_small_batches
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row, repeated ones too; null texts have size 16."""
    return kdtree.shard_documents(docs, shards=40)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark_leaks),
    ("mixing_sources", mix_sources),
    ("kdtree_sharding", shard),
]

#: Learned models and similarity components can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with closed_after():
            docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
