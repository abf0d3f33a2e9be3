"""Quality gates. Each gives a report row or raises; bounds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table breaks a promise that later stages count on."""


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def key_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct keys, keys that occur more than once. A single aggregation by key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("k"))
    return counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("k") > 1).alias("n_duplicated"))


def require_range(df: DataFrame, least: int, most: int) -> int:
    n = df.count()
    if not least <= n <= most:
        raise GateError(f"{n} rows; expected {least} to {most}")
    return n


def require_unique(df: DataFrame, keys: list[str]) -> None:
    found = duplicate_groups(df, keys).limit(1).collect()
    if found:
        raise GateError(f"{keys} is not unique: {found[0]}")


def require_contained(df: DataFrame, other: DataFrame, key: str) -> None:
    found = df.join(other.select(key), key, "left_anti").limit(1).collect()
    if found:
        raise GateError(f"{key} has values that the other table lacks: {found[0]}")


def alignment(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are not in all tables, with the number of tables that have them."""
    parts = [df.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("held_by")) for name, df in tables.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.distinct().groupBy("key").agg(F.count("*").alias("n_tables")).filter(F.col("n_tables") < len(tables))
