"""The stages from a shell: python -m corpusflow.cli STAGE --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from . import config, schemas
from .functions.html import html_to_text
from .operators import diagnose, enrich, evaluate, lexical, segment
from .plans import stages
from .scratch import Scratch
from .session import session
from .sources import readers, settings, sinks


def scope(spark, a) -> None:
    content = readers.read_ids(spark, a.content)
    rules = settings.read_scope(a.config) if a.config else config.Scope()
    sinks.write_parquet(stages.scope_stage(readers.read_table(spark, a.metadata, schema=schemas.METADATA), content, rules, check=not a.no_gates), a.output)


def parse(spark, a) -> None:
    content = readers.read_table(spark, a.content or readers.discover(spark, a.folder))
    articles, failures = stages.parse_stage(spark.read.parquet(a.scoped), content, a.output)
    print(f"{articles.count()} articles of {articles.select('doc_id').distinct().count()} documents, {failures.count()} failures")


def chunk(spark, a) -> None:
    fixes = readers.read_fixes(spark, a.fixes) if a.fixes else None
    sinks.write_parquet(stages.chunk_stage(spark.read.parquet(a.articles), fixes, a.max_tokens), a.output)


def summarise(spark, a) -> None:
    chunks = spark.read.parquet(a.chunks)
    if a.limit:
        chunks = chunks.orderBy("chunk_id").limit(a.limit)
    out = stages.enrich_stage(chunks, a.log, retry_empty=a.retry_empty)
    sinks.write_parquet(enrich.at_rest(out), a.output)
    enrich.coverage(out).show()


def graph(spark, a) -> None:
    enriched = spark.read.parquet(a.enriched)
    nodes, edges = stages.knowledge_graph(spark.read.parquet(a.scoped), enriched, readers.read_table(spark, a.relationships, schema=schemas.RELATIONSHIPS))
    sinks.write_parquet(nodes, f"{a.output}/nodes")
    sinks.write_parquet(edges, f"{a.output}/edges")


def index(spark, a) -> None:
    enriched = spark.read.parquet(a.enriched)
    lexical.save(lexical.build_index(enriched, "chunk_id", "enriched_text"), f"{a.output}/bm25")
    stages.vectors_stage(enriched.withColumn("key", F.from_json("key", "array<string>")), f"{a.output}/vectors")


def answer(spark, a) -> None:
    questions = readers.read_table(spark, a.questions, schema=schemas.QUESTIONS)
    enriched, edges, nodes = spark.read.parquet(a.enriched), spark.read.parquet(f"{a.graph}/edges"), spark.read.parquet(f"{a.graph}/nodes")
    names = nodes.filter("type = 'Document'").select("node_id", F.col("attributes")["ten"].alias("name"))
    bm25, vectors = (lexical.load(spark, f"{a.index}/bm25"), spark.read.parquet(f"{a.index}/vectors")) if a.index else (None, None)

    def some(part):
        scratch = Scratch(spark, "answer")
        asked = stages.question_vectors(part) if a.index else None
        hits = scratch.table(stages.retrieve(part, enriched, edges, vectors, asked, index=bm25))
        return stages.generate_stage(part, hits, edges, names) if a.generate else stages.answer_stage(part, hits)

    print(sinks.write_submission(stages.answer_in_parts(questions, f"{a.output}/records", some, a.part), a.output))


def score(spark, a) -> None:
    gold, predicted = (spark.read.schema("id long, relevant_articles array<string>").json(p, multiLine=True) for p in (a.gold, a.results))
    evaluate.macro(evaluate.per_question(predicted, gold)).show()


def failures(spark, a) -> None:
    found = readers.read_table(spark, a.failures, schema=schemas.FAILURES)
    diagnose.histogram(found).show(truncate=False)
    some = diagnose.stratified_sample(found, "reason", "doc_id", a.sample, a.seed)
    diagnose.inspect(some, readers.read_table(spark, a.content), spark.read.parquet(a.articles), segment.Patterns().heading, html_to_text).select(*(F.col(c) for c in ("doc_id", "reason", "text_length", "n_headings", "outline", "in_articles"))).show(a.sample, truncate=120)


#: Options of each stage; those with None are needed.
STAGES = {
    scope: dict(metadata=None, content=None, output=None, config="", no_gates=False),
    parse: dict(scoped=None, output=None, content="", folder="."),
    chunk: dict(articles=None, output=None, fixes="", max_tokens=1024),
    summarise: dict(chunks=None, log=None, output=None, limit=0, retry_empty=False),
    graph: dict(scoped=None, enriched=None, relationships=None, output=None),
    index: dict(enriched=None, output=None),
    answer: dict(questions=None, enriched=None, graph=None, output=None, index="", part=50, generate=False),
    score: dict(results=None, gold=None),
    failures: dict(failures=None, content=None, articles=None, sample=10, seed=42),
}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    sub = parser.add_subparsers(dest="stage", required=True)
    for run, options in STAGES.items():
        p = sub.add_parser(run.__name__)
        p.set_defaults(run=run)
        for name, value in options.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(value, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, required=value is None, default=value, type=type(value) if value is not None else str)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(sys.argv[1:] if argv is None else argv)
    a.run(session(), a)


if __name__ == "__main__":
    main()
