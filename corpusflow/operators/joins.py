"""The join shapes of the pipeline. Ids are compared as strings; null ids match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def having_content(df: DataFrame, content: DataFrame, key: str = "id") -> DataFrame:
    """Semi join by id, compared as strings."""
    ids = content.select(F.col(key).cast("string").alias("_id")).distinct()
    return df.join(ids, F.col(key).cast("string") == F.col("_id"), "left_semi")


def not_cached(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return df.join(cache.select(key).distinct(), key, "left_anti")


def with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Left join; the other side's columns get a default where it has no row."""
    joined = df.join(other.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def marked(df: DataFrame, other: DataFrame, key: str, mark: str) -> DataFrame:
    """All rows, with a flag that tells whether the other side knows the key."""
    seen = other.select(key).distinct().withColumn(mark, F.lit(True))
    return df.join(seen, key, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))


def both_ends_in(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    ids = nodes.select(F.col(key).cast("string").alias("_id")).distinct()
    near = edges.join(ids, F.col(src).cast("string") == F.col("_id"), "left_semi")
    return near.join(ids, F.col(dst).cast("string") == F.col("_id"), "left_semi")


def mapped(label: Column, names: dict[str, str]) -> Column:
    """A label's name; labels without one stay as they are."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), label) if pairs else label
