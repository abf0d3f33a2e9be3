"""Resumable enrichment: summarise what the log lacks, append it to the log, join the log's last records to the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..models import Summariser, first_sentence_summary
from . import dedup, joins


def last_records(log: DataFrame) -> DataFrame:
    """Of each chunk_id the record with the greatest ``seq``, without one by place; records without an id don't count."""
    place = [c for c in ("_file", "_block", "_row") if c in log.columns]
    order = [F.col("seq").desc_nulls_last(), *(F.col(c).desc() for c in place)]
    return dedup.first_of(log.filter("coalesce(chunk_id, '') <> ''"), ["chunk_id"], order).drop("seq", *place)


def pending(chunks: DataFrame, cache: DataFrame, retry_empty: bool = False) -> DataFrame:
    """Chunks without a cached summary; with ``retry_empty`` an empty one counts as none."""
    return joins.not_cached(chunks, cache.filter("short <> '' or size(key) > 0") if retry_empty else cache, "chunk_id")


def summarise_pending(chunks: DataFrame, cache: DataFrame, summarise: Summariser = first_sentence_summary, retry_empty: bool = False) -> DataFrame:
    return summarise(pending(chunks, cache, retry_empty).select("chunk_id", "chunk_text"))


def enrich(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per chunk, with short, key and enriched_text."""
    joined = joins.with_defaults(chunks, cache, "chunk_id", {"short": F.lit(""), "key": F.array().cast("array<string>")})
    return joined.withColumn("enriched_text", X.enriched_text(F.col("short"), F.col("key"), F.col("chunk_text")))


def coverage(enriched: DataFrame) -> DataFrame:
    """One row: chunks, and the shares that have a summary and key points."""
    has_short, has_key = X.strip(F.col("short")) != "", F.size("key") > 0
    return enriched.agg(F.count("*").alias("n_chunks"), F.avg(has_short.cast("int")).alias("short_rate"), F.avg(has_key.cast("int")).alias("key_rate"))


def at_rest(enriched: DataFrame) -> DataFrame:
    """``key`` as a JSON string, as files hold it."""
    return enriched.withColumn("key", F.to_json("key"))
