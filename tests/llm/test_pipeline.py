"""Each stage's decisions on its own input, and odd rows through the whole pipeline."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusflow.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_on_the_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [], [docs.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        names.append(name)
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == list(P.COLUMNS)
            assert docs.join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
        if k == 1:
            found = P.jaccard.join_components(before)
            assert docs.count() == found.agg(F.countDistinct(F.coalesce("component_key", -F.col("doc_id")))).first()[0]
            assert docs.join(found.filter("doc_id = component_id"), "doc_id", "left_anti").count() == 0
        if k == 2:
            leaks = {r.doc_id for r in P.decontaminate.find_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in before.select("doc_id").collect()} - leaks == {r.doc_id for r in docs.select("doc_id").collect()} and leaks
        if k == 3:
            taken = {r.doc_id: r.taken // max(1, r.size) for r in P.mixing.mix_sources(before).collect()}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {d: n for d, n in taken.items() if n}
    assert 4 <= len(names) <= 5 and counts[4] == counts[5]
    assert P.run(spark, SF).count() == counts[5]


def test_odd_rows(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text + "x", "en", "a", 1), (None, None, None, None, None), (3, "", "de", "b", 0), (4, "12", "de", "b", 0), (5, "der kleine Hund", "de", "b", 0), (5, "der große Hund", "de", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, text), (5, "der große Hund"), (5, "der kleine Hund")]
    empty = spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, empty, SF).write.parquet(str(tmp_path / f"e{k}"))
        empty = spark.read.parquet(str(tmp_path / f"e{k}"))
        assert empty.count() == 0


def test_every_query_covers_its_table(spark):
    n = pq.ParquetFile(f"{SF}/documents.parquet").metadata.num_rows
    for name, query in queries.QUERIES.items():
        if not name.startswith(("op4", "op7", "op8")):
            assert query(spark, SF).count() == n, name
