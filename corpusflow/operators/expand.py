"""Graph expansion in set form: hops are equi-joins, and the sequential maxima are one aggregate.

With seeds s: D(x) is the best discounted score over paths article -> document -> related document -> article; C(x) over seeds
that share a concept with x and are another article. A seed's score is the greater of its own and D; any other chunk's the
greater of D and C. Queries meet few chunks of each document and concept, not all, so the work doesn't grow with queries times chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..scratch import Scratch
from . import dedup


def expand(seeds: DataFrame, chunks: DataFrame, edges: DataFrame, query_key: str = "qid", relations: tuple[str, ...] = config.TRAVERSED_RELATIONS, params: config.Retrieval | None = None, scratch: Scratch | None = None) -> DataFrame:
    """seeds: query_key, chunk_id, score. chunks: chunk_id, doc_uid, part_idx. Gives query_key, chunk_id, score, rank, as a scratch table.

    seeds and edges are read more than once. An article is reached at its first chunk (part_idx 0).
    """
    p = params or config.Retrieval()
    scratch = scratch or Scratch(seeds.sparkSession, "expand")
    articles = chunks.select("chunk_id", F.concat(F.lit("ART:"), "doc_uid").alias("art"), "part_idx")
    first_chunks = articles.filter("part_idx = 0").select("art", "chunk_id")
    own = scratch.table(seeds.join(articles, "chunk_id").select(query_key, "chunk_id", "art", "score", (F.col("part_idx") == 0).alias("first")))
    best = own.groupBy(query_key, "art").agg(F.max("score").alias("score"))
    none = F.lit(None).cast("double")

    # groups of articles that the seeds reach: related documents, and concepts
    holds = edges.filter("rel = 'HAS_ARTICLE'").select(F.col("src").alias("doc"), F.col("dst").alias("art"))
    related = edges.filter(F.col("rel").isin(list(relations))).select(F.col("src").alias("doc"), F.col("dst").alias("grp"))
    docs = scratch.table(own.select("art").distinct().join(holds, "art").distinct())
    by_doc = best.join(docs, "art").groupBy(query_key, "doc").agg(F.max("score").alias("score"))
    reached = by_doc.join(related, "doc").groupBy(query_key, "grp").agg((F.max("score") * p.discount_doc).alias("d"))
    mentions = edges.filter("rel = 'MENTIONS'").select(F.col("src").alias("art"), F.col("dst").alias("grp"))
    # of each concept the best two articles are enough: one of them is another article than x
    mentioned = scratch.table(best.select("art").distinct().join(mentions, "art").distinct())
    leaders = dedup.top_k(best.join(mentioned, "art"), [query_key, "grp"], [F.col("score").desc(), F.col("art").asc()], 2, "place")
    leaders = leaders.select(query_key, "grp", F.col("art").alias("seed_art"), (F.col("score") * p.discount_concept).alias("c"))

    # All that a query reaches through one group has the same score there, so only the group's first chunks by chunk_id can come
    # among the first: as many as are kept, and as many more as can score less than the group gives (a query's seeds, which take
    # no score from concepts, and the first chunks of a concept's best article). Seeds take their document scores apart.
    n_seeds = own.groupBy(query_key).count().agg(F.max("count")).first()[0] or 0
    n_first = best.select("art").distinct().join(first_chunks, "art").groupBy("art").count().agg(F.max("count")).first()[0] or 0
    groups = scratch.table(reached.select("grp").union(leaders.select("grp")).distinct())
    members = mentions.unionByName(holds.withColumnRenamed("doc", "grp")).join(groups, "grp", "left_semi").join(first_chunks, "art").select("grp", "art", "chunk_id").distinct()
    members = scratch.table(dedup.top_k(members, ["grp"], [F.col("chunk_id").asc(), F.col("art").asc()], p.expanded_top + n_seeds + n_first, "place").drop("place"))
    d = reached.join(members, "grp").select(query_key, "chunk_id", none.alias("s"), "d", none.alias("c"))
    seed_docs = own.filter("first").join(docs, "art").select(query_key, "chunk_id", "doc")
    seed_d = seed_docs.join(reached.withColumnRenamed(query_key, "_q"), (F.col("doc") == F.col("grp")) & F.col(query_key).eqNullSafe(F.col("_q"))).select(query_key, "chunk_id", none.alias("s"), "d", none.alias("c"))
    c = leaders.join(members, "grp").filter("art <> seed_art").select(query_key, "chunk_id", none.alias("s"), none.alias("d"), "c")

    rows = seeds.select(query_key, "chunk_id", F.col("score").alias("s"), none.alias("d"), none.alias("c")).unionByName(d).unionByName(seed_d).unionByName(c)
    merged = rows.groupBy(query_key, "chunk_id").agg(F.max("s").alias("s"), F.max("d").alias("d"), F.max("c").alias("c"))
    score = F.when(F.col("s").isNotNull(), F.greatest("s", "d")).otherwise(F.greatest("d", "c"))
    scored = merged.select(query_key, "chunk_id", F.round(score, 9).alias("score"))
    return scratch.table(dedup.top_k(scored, [query_key], [F.col("score").desc(), F.col("chunk_id").asc()], p.expanded_top))
