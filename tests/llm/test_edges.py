"""What all operators share: columns whose names clash, very long texts, repeated rows, tables that go when they are done."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusflow.llm import common, decontaminate, hamming, jaccard, kdtree, language_id, mixing, quality, suffix_dedup, toxicity, url_filter
from corpusflow.scratch import Scratch, closed_after


def documents(spark):
    """Texts over a piece of bytes and over a megabyte, repeated rows, nulls, and every column once more in capitals."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["the", "cat", "sat", "on", "mat", f"w{rng.randrange(99)}"]) for _ in range(n))
    texts = [text(300_000), text(50), text(8), None, "", "x" * (common.PIECE_BYTES + 5)] + [text(40) for _ in range(10)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, texts[2], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("other").alias(c.upper()) for c in df.columns), F.lit(1).alias("sig"), F.lit(2).alias("key"), F.lit(3).alias("shard"))


LABELS = "doc_id long, toxic int, grade int"


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op9", "op10"])
def test_odd_documents(spark, name):
    docs = documents(spark)
    n = docs.count()
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], LABELS)
    items = spark.createDataFrame([(1, "the cat sat on the mat and w1 w2 w3 ran"), (1, "the cat sat on the mat and w1 w2 w3 ran"), (None, None)], "item_id long, text string")
    run = {
        "op1": lambda d: kdtree.shard_documents(d, shards=4), "op2": lambda d: quality.select_by_quality(d, labels, F.lit(True), 3, 1), "op3": suffix_dedup.remove_repeats,
        "op5": lambda d: toxicity.toxicity_of_documents(d, labels, F.lit(True)), "op6": mixing.mix_sources, "op7": lambda d: decontaminate.find_leaks(d, items),
        "op9": lambda d: language_id.language_of_documents(d, F.lit(True)), "op10": jaccard.join_components,
    }[name]
    out = run(docs)
    assert out.count() == n if name != "op7" else out.count() >= 0
    assert run(docs.limit(0)).count() == 0


def test_odd_urls_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://A.b/c", "http://x/"), (1, "http://A.b/c", "http://x/"), (None, None, None)], "page_id long, url string, other string").withColumnRenamed("other", "URL")
    rules = [("allow", "b", "/c"), ("block", "b", "/c")]  # of equal rules the later
    assert sorted((str(r.page_id), r.host, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()) == [("1", "a.b", "block")] * 2 + [("None", "", "allow")]
    vectors = spark.createDataFrame([(0, [1.0, -1.0], 1), (20, [1.0, 1.0], 1), (20, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, EMBEDDING int")
    assert {(r.query_id, r.neighbour_id, r.distance) for r in hamming.nearest(vectors, F.col("id") % 20 == 0).collect()} == {(0, 20, 1), (20, 0, 1)}


def test_stages_take_odd_documents(spark, tmp_path):
    docs = documents(spark)
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert k == 4 or out.columns == list(P.COLUMNS)
        out.write.parquet(str(tmp_path / str(k)))
        assert k != 2 or spark.read.parquet(str(tmp_path / "2")).count() == docs.count()


def test_one_row_of_a_key_is_always_the_same(spark):
    rows = [(1, "a b", lang, source, n) for lang, source, n in (("fr", "x", 3), ("en", "z", 1), ("en", "y", 2), (None, "q", 9))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for parts in (1, 3):
        got = P._once(P._keyed(spark.createDataFrame(rows, schema).repartition(parts))).select(*P.COLUMNS).collect()
        assert [tuple(r) for r in got] == [(1, "a b", None, "q", 9)]


def test_scratch_tables_go(spark):
    import os

    with closed_after():
        scratch = Scratch(spark, "test")
        scratch.table(spark.range(3))
        path = scratch.root.removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path) and scratch not in Scratch.opened
