"""Reciprocal rank fusion of any number of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedup


def fuse(rankings: list[DataFrame], query_key: str, key: str, k: int = 60, top: int = 30) -> DataFrame:
    """rankings have query_key, key and rank (from 1). Gives query_key, key, score, rank."""
    both = reduce(DataFrame.unionByName, (r.select(query_key, key, "rank") for r in rankings))
    scores = both.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return dedup.top_k(scores, [query_key], [F.col("score").desc(), F.col(key).asc()], top)
