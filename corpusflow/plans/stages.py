"""The stages from metadata to enriched chunks, and from questions to a submission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import text as X
from ..functions.html import html_to_text
from ..models import Embedder, Generator, Summariser, first_context_answer, first_sentence_summary, word_counts
from ..operators import answer, chunk, dedup, dense, enrich, expand, fuse, gates, graph, lexical, scope, segment
from ..scratch import Scratch
from ..sources import readers, sinks


def scope_stage(metadata: DataFrame, content: DataFrame, settings: config.Scope | None = None, check: bool = True) -> DataFrame:
    out = scope.scope_filter(metadata, content, settings, check=check)
    if check:
        gates.require_unique(out, ["law_id", "ten_van_ban"])
    return out


def parse_documents(scoped: DataFrame, content: DataFrame, patterns: segment.Patterns | None = None, limits: config.Limits | None = None, to_text=html_to_text) -> DataFrame:
    """Scoped documents with records, reason and num_dieu. The join comes before the HTML is parsed."""
    docs = dedup.keep_first(scoped.withColumn("_id", F.col("id").cast("string")), ["_id"], ["id"])
    bodies = readers.content_of(content, docs.select(F.col("_id").alias("id"))).withColumnRenamed("id", "_id")
    texts = docs.join(bodies, "_id").withColumn("html", to_text(F.col("html")))
    return segment.outcome(texts.withColumn("clean_text", X.clean_text(F.col("html"))).drop("html", "_id"), patterns or segment.Patterns(), limits or config.Limits())


def parse_stage(scoped: DataFrame, content: DataFrame, path: str, patterns: segment.Patterns | None = None, limits: config.Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, failures). The parse is written once to ``path`` and read by both."""
    patterns, limits = patterns or segment.Patterns(), limits or config.Limits()
    spark = scoped.sparkSession
    sinks.write_parquet(parse_documents(scoped, content, patterns, limits), f"{path}/parsed")
    parsed = spark.read.parquet(f"{path}/parsed")
    articles = dedup.keep_longest(segment.articles(parsed, list(patterns.headers)), ["doc_id", "dieu_so"], "noi_dung", ["start_char"])
    gates.require_unique(articles, ["doc_uid"])
    failures = segment.failures(parsed, limits)
    sinks.write_parquet(articles, f"{path}/articles")
    sinks.write_failures(failures, f"{path}/failures")
    return spark.read.parquet(f"{path}/articles"), failures


def chunk_stage(articles: DataFrame, fixes: DataFrame | None = None, most: int = 1024) -> DataFrame:
    if fixes is not None:
        articles = dedup.override_last(articles, fixes, ["doc_uid"], ["start_char"])
    return chunk.chunk_articles(articles, most)


def enrich_stage(chunks: DataFrame, log_path: str, summarise: Summariser = first_sentence_summary, retry_empty: bool = False) -> DataFrame:
    """Summarises what the log lacks, appends it, and returns all chunks enriched."""
    spark = chunks.sparkSession
    log = readers.read_summary_log(spark, log_path)
    seq = readers.next_seq(log)
    sinks.append_summaries(enrich.summarise_pending(chunks, enrich.last_records(log), summarise, retry_empty), log_path, seq)
    return enrich.enrich(chunks, enrich.last_records(readers.read_summary_log(spark, log_path)))


def vectors_stage(enriched: DataFrame, path: str, embed: Embedder = word_counts) -> DataFrame:
    """The summary and the full index, written to ``path``; reading that Parquet is loading them."""
    sinks.write_parquet(dense.build_vectors(enriched, embed), path)
    return enriched.sparkSession.read.parquet(path)


def question_vectors(questions: DataFrame, embed: Embedder = word_counts) -> DataFrame:
    return questions.select(F.col("id").alias("qid"), embed(F.col("question")).alias("vector"))


def retrieve(questions: DataFrame, enriched: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, params: config.Retrieval | None = None, index: lexical.LexicalIndex | None = None) -> DataFrame:
    """Hits (qid, rank, rerank_score and the chunk's columns). vectors: chunk_id, summary, full; question_vectors: qid, vector."""
    p = params or config.Retrieval()
    index = index or lexical.build_index(enriched, "chunk_id", "enriched_text")
    asked = questions.select(F.col("id").alias("qid"), "question")
    rankings = [lexical.search(index, asked, "qid", "question", p.top_lexical, p.k1, p.b)]
    if vectors is not None and question_vectors is not None:
        rankings += [dense.search(vectors, question_vectors, "chunk_id", c, "qid", "vector", p.top_dense) for c in ("summary", "full")]
    fused = Scratch(questions.sparkSession, "fused").table(fuse.fuse(rankings, "qid", "chunk_id", p.rrf_k, p.fused_top))
    wide = expand.expand(fused.select("qid", "chunk_id", "score"), enriched, edges, params=p)
    candidates = wide.select("qid", "chunk_id").join(enriched, "chunk_id").join(asked, "qid")
    return answer.rerank(candidates, k=p.final_top, most_chars=p.rerank_chars)


def answer_stage(questions: DataFrame, hits: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Submission records. generated: qid, answer; without it the extractive fallback answers."""
    answers = answer.fallback_answers(hits) if generated is None else answer.answered(generated, hits)
    return answer.submission(questions, answers, hits)


def generate_stage(questions: DataFrame, hits: DataFrame, edges: DataFrame, documents: DataFrame, generate: Generator = first_context_answer) -> DataFrame:
    """Submission records with generated answers. documents: node_id, name."""
    return answer_stage(questions, hits, generate(answer.prompts(questions, hits, edges, documents)))


def answer_in_parts(questions: DataFrame, path: str, answer_some, part: int = 50) -> DataFrame:
    """Records of all questions, written under ``path`` after every ``part`` questions, so that a broken run goes on where it was.

    answer_some: questions -> records. Ids that ``path`` holds aren't asked again; a failed part leaves nothing behind.
    """
    spark = questions.sparkSession
    read = lambda: spark.read.schema(schemas.RESULTS).parquet(path)
    left = questions if not readers.exists(spark, path) else questions.join(read().select("id"), "id", "left_anti")
    ids = [r.id for r in left.select("id").distinct().orderBy("id").limit(sinks.MOST_RECORDS).collect()]
    for i in range(0, len(ids), part):
        some = questions.filter(F.col("id").between(ids[i], ids[min(i + part, len(ids)) - 1])).join(left.select("id"), "id", "left_semi")
        answer_some(some).write.mode("append").parquet(path)
    return read() if ids or readers.exists(spark, path) else spark.createDataFrame([], schemas.RESULTS)


def knowledge_graph(scoped: DataFrame, enriched: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.build(scoped, enriched, relationships)
