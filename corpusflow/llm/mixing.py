"""Operator 6: mixing sources to target weights by weighted fair queueing.

The documents of each source are put in a shuffled order (by a hash). A document's virtual finish time is the running sum of its
source's words, the document included, divided by the source's target; a second round through the source goes on from the first.
All sources thus advance at one pace, and finish their targets at time 1. The finish times are sorted globally by range, and
the mix ends where the running sum of all words reaches the budget.

Both running sums are distributed: rows are range-partitioned, each task sums its own, and one number per task (and source) is
carried over, so a source with a third of all rows spans many tasks. Targets need one row per source.

Defined results: a null text has no words; documents without words are returned with taken 0. A null source is a source of its
own. Repeated rows are queued one by one; which of two equal rows is taken more often is open, the multiset of results is not.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, running_totals

WORDS = r"[^\x20\x09-\x0D]+"


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight; none above ``most`` times its size, the excess going to the others by weight."""
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        pool = budget - sum(t for i, t in enumerate(targets) if i not in free)
        whole = sum(weights[i] for i in free)
        over = {i for i in free if pool * weights[i] / whole > most * sizes[i]}
        for i in over or free:
            targets[i] = most * float(sizes[i]) if over else pool * weights[i] / whole
        free = free - over if over else set()
    return targets


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, most_rounds: int = 2, seed: int = 17) -> DataFrame:
    """docs: doc_id, text, source. Adds to every row (doc_id, text_key): size, source_size, target and taken.

    ``weights`` are dealt to the sources by code point, null last, over and over.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = columns_or_null(docs, doc_id="long", text="string", source="string")
    sized = scratch.table(
        rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("queue"))
        .withColumn("place", F.xxhash64("doc_id", "text_key", F.lit(seed)))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    per_source = sized.groupBy("queue").agg(F.sum("size").alias("n")).collect()  # a row per source
    named = sorted((r for r in per_source), key=lambda r: (r["queue"] == "", r["queue"].encode()))
    sizes = [int(r["n"]) for r in named]
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(named))], budget_share * sum(sizes), float(most_rounds))
    schema = "queue string, source_size long, target double"
    sources = spark.createDataFrame([(r["queue"], n, t) for r, n, t in zip(named, sizes, targets, strict=True)], schema)
    if len(named) <= 100_000:  # beyond that, shuffled joins, whose hot sources Spark splits
        sources = F.broadcast(sources)
    queued = running_totals(scratch, sized.filter("size > 0"), "queue", ["place", "doc_id", "uid"], "size", partitions)
    turns = queued.join(sources, "queue").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most_rounds - 1))))
    finish = (F.col("total") + F.col("turn") * F.col("source_size")) / F.col("target")
    timed = turns.filter("target > 0").select("uid", "size", "place", "turn", finish.alias("finish"), F.lit("").alias("all"))
    summed = running_totals(scratch, timed, "all", ["finish", "place", "uid", "turn"], "size", partitions)
    taken = summed.filter(F.col("total") <= budget_share * sum(sizes)).groupBy("uid").agg(F.sum("size").alias("taken"))
    return (
        sized.join(taken, "uid", "left").join(sources, "queue")
        .select("doc_id", "text_key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "uid")
    )
