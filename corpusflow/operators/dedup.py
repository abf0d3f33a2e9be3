"""Keep one row of each key, by an explicit order. Spark limits each key's rows before the shuffle, so hot keys stay small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def keep_first(df: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    return first_of(df, keys, [F.col(c).asc() for c in ordinal])


def keep_longest(df: DataFrame, keys: list[str], text: str, ties: list[str]) -> DataFrame:
    return first_of(df, keys, [F.length(text).desc_nulls_last(), *(F.col(c).asc() for c in ties)])


def override_last(base: DataFrame, fixes: DataFrame, keys: list[str], ordinal: list[str]) -> DataFrame:
    """The union of both; of each key the fix, or else the last row."""
    both = base.withColumn("_source", F.lit(0)).unionByName(fixes.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return first_of(both, keys, [F.col("_source").desc(), *(F.col(c).desc_nulls_last() for c in ordinal)]).drop("_source")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)
