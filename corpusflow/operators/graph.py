"""The knowledge graph as two tables: nodes(node_id, type, attributes) and edges(src, dst, rel), a bag of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from . import dedup, joins


def node_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), c.cast("string"))


def _attributes(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def document_nodes(docs: DataFrame) -> DataFrame:
    c = F.col
    return docs.select(node_id("DOC", c("id")).alias("node_id"), F.lit("Document").alias("type"), _attributes(law_id=c("law_id"), ten=c("ten_van_ban"), loai=c("loai_van_ban"), nganh=c("nganh"), ngay_ban_hanh=c("ngay_ban_hanh")).alias("attributes"))


def article_nodes(chunks: DataFrame) -> DataFrame:
    """One node per doc_uid, from its first chunk."""
    first = dedup.keep_first(chunks, ["doc_uid"], ["part_idx", "chunk_id"])
    c = F.col
    return first.select(node_id("ART", c("doc_uid")).alias("node_id"), F.lit("Article").alias("type"), _attributes(doc_uid=c("doc_uid"), law_id=c("law_id"), ten_van_ban=c("ten_van_ban"), dieu=c("dieu_so"), summary=c("short")).alias("attributes"))


def concept_nodes(spark, concepts: tuple[str, ...] = config.CONCEPTS) -> DataFrame:
    return spark.createDataFrame([(x,) for x in concepts], "name string").select(node_id("CONCEPT", F.lower("name")).alias("node_id"), F.lit("Concept").alias("type"), _attributes(name=F.col("name")).alias("attributes"))


def has_article_edges(chunks: DataFrame) -> DataFrame:
    pairs = chunks.select(node_id("DOC", F.col("doc_id")).alias("src"), node_id("ART", F.col("doc_uid")).alias("dst")).distinct()
    return pairs.withColumn("rel", F.lit("HAS_ARTICLE"))


def relation_edges(relationships: DataFrame, docs: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Document edges with both ends in scope; labels without a name stay as they are."""
    near = joins.both_ends_in(relationships, docs, "doc_id", "other_doc_id", "id")
    return near.select(node_id("DOC", F.col("doc_id")).alias("src"), node_id("DOC", F.col("other_doc_id")).alias("dst"), joins.mapped(F.col("relationship"), config.RELATION_LABELS if labels is None else labels).alias("rel"))


def unmapped_labels(relationships: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    known = list(config.RELATION_LABELS if labels is None else labels)
    return relationships.filter(~F.coalesce(F.col("relationship").isin(known), F.lit(False))).groupBy("relationship").agg(F.count("*").alias("n_edges"))


def mentions(texts: DataFrame, key: str, text: str, concepts: tuple[str, ...] = config.CONCEPTS) -> DataFrame:
    """(key, concept) wherever the text holds the concept, in any case. The list is a literal, so rows are neither joined nor shuffled."""
    found = X.let(F.lower(F.col(text)), lambda low: F.filter(F.array(*(F.lit(x.lower()) for x in concepts)), lambda x: F.contains(low, x)))
    return texts.select(key, F.explode(found).alias("concept"))


def mention_edges(chunks: DataFrame, concepts: tuple[str, ...] = config.CONCEPTS) -> DataFrame:
    """An edge for every chunk that mentions a concept."""
    return mentions(chunks, "doc_uid", "enriched_text", concepts).select(node_id("ART", F.col("doc_uid")).alias("src"), node_id("CONCEPT", F.col("concept")).alias("dst"), F.lit("MENTIONS").alias("rel"))


def build(docs: DataFrame, chunks: DataFrame, relationships: DataFrame, labels: dict[str, str] | None = None, concepts: tuple[str, ...] = config.CONCEPTS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    nodes = [document_nodes(docs), article_nodes(chunks), concept_nodes(docs.sparkSession, concepts)]
    edges = [has_article_edges(chunks), relation_edges(relationships, docs, labels), mention_edges(chunks, concepts)]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
