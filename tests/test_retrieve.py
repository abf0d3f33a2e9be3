"""Retrieval with vectors beside BM25."""

import pytest
from pyspark.sql import functions as F

from corpusflow.models import pandas_generator
from corpusflow.plans import stages


def test_dense_rankings_are_fused(spark):
    chunk = lambda i, text: (i, i, 0, text)
    chunks = spark.createDataFrame([chunk("a", "red apple"), chunk("b", "green pear"), chunk("c", "blue plum"), chunk("d", "grey stone")], "chunk_id string, doc_uid string, part_idx int, enriched_text string")
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    questions = spark.createDataFrame([(1, "red")], "id long, question string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0]), ("b", [0.0, 1.0], [0.0, 3.0]), ("c", [0.6, 0.8], [0.8, 0.6])], "chunk_id string, summary array<double>, full array<double>")
    asked = spark.createDataFrame([(1, [0.0, 2.0])], "qid long, vector array<double>")
    assert {r.chunk_id for r in stages.retrieve(questions, chunks, edges).collect()} == {"a"}
    assert {r.chunk_id for r in stages.retrieve(questions, chunks, edges, vectors, asked).collect()} == {"a", "b", "c"}


def test_a_broken_run_goes_on(spark, tmp_path):
    """Records are written part by part; questions that have theirs aren't asked again."""
    path, calls = str(tmp_path / "records"), []
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(7)], "id long, question string")

    def some(part, fail=False):
        ids = sorted(r.id for r in part.collect())
        if fail and 4 in ids:
            raise RuntimeError("broken")
        calls.append(ids)
        none = F.array().cast("array<string>")
        return part.select("id", "question", F.lit("a").alias("answer"), none.alias("relevant_docs"), none.alias("relevant_articles"))

    with pytest.raises(RuntimeError):
        stages.answer_in_parts(questions, path, lambda p: some(p, True), 2)
    assert calls == [[0, 1], [2, 3]]
    out = stages.answer_in_parts(questions, path, some, 2)
    assert calls[2:] == [[4, 5], [6]] and sorted(r.id for r in out.collect()) == list(range(7))
    assert stages.answer_in_parts(questions, path, some, 2).count() == 7 and len(calls) == 4


def test_generators(spark):
    prompts = spark.createDataFrame([(1, "s", "p"), (2, "s", "q")], "qid long, system string, prompt string")
    made = pandas_generator(lambda system, prompt: [f"{a}:{b}" for a, b in zip(system, prompt, strict=True)])(prompts)
    assert sorted(map(tuple, made.collect())) == [(1, "s:p"), (2, "s:q")]
