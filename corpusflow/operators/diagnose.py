"""Failure diagnostics: counts by reason, a stratified sample, and a closer look at sampled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins


def histogram(failures: DataFrame, reason: str = "reason") -> DataFrame:
    return failures.groupBy(reason).agg(F.count("*").alias("n_failures")).orderBy(F.col("n_failures").desc(), reason)


def summary(failures: DataFrame, reason: str = "reason") -> DataFrame:
    """One row: total_failures and the counts by reason, as a map."""
    counts = failures.groupBy(reason).agg(F.count("*").alias("n"))  # a row per reason
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_failures"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("by_reason"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first row (by key) of each stratum, larger strata first, filled up to n in an order that a hash shuffles."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    first = F.row_number().over(W.partitionBy(stratum).orderBy(key)) == 1
    placed = rows.withColumn("_first", first).join(sizes, stratum)
    order = [F.col("_first").desc(), F.when(F.col("_first"), -F.col("_size")), F.when(F.col("_first"), F.col(stratum)), F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.col(key)]
    return placed.orderBy(*order).limit(n).drop("_first", "_size")


def inspect(failures: DataFrame, content: DataFrame, articles: DataFrame, heading: str, to_text=lambda c: c, preview: int = 500, most: int = 10, most_lines: int = 20) -> DataFrame:
    """Per failed document: text length and preview, its first headings (or first lines if it has none), and whether articles have it."""
    body = F.coalesce(F.nullif(F.col("content_html"), F.lit("")), F.col("content") if "content" in content.columns else F.lit(None).cast("string"), F.lit(""))
    texts = content.select(F.col("id").cast("string").alias("doc_id"), to_text(body).alias("_text")).withColumn("_text", X.clean_text(F.col("_text")))
    rows = failures.join(texts, "doc_id", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    found = X.mark_and_split(F.col("_text"), heading, 3)
    heads = F.transform(F.slice(found, 1, most), lambda m: F.concat_ws(" ", m["groups"][0], X.strip(m["groups"][2])))
    lines = F.slice(X.non_blank(F.split("_text", "\n")), 1, most_lines)
    seen = joins.marked(rows, articles.select("doc_id"), "doc_id", "in_articles")
    return seen.select(*failures.columns, F.length("_text").alias("text_length"), F.substring("_text", 1, preview).alias("preview"), F.size(found).alias("n_headings"), F.when(F.size(found) > 0, heads).otherwise(lines).alias("outline"), "in_articles")
