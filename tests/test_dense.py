"""Exact vector search against all inner products."""

import numpy as np

from corpusflow.operators import dense
from corpusflow.plans import queries


def brute(vectors, asked, k):
    """(query, key, score, rank), vectors and asked being {key: vector}."""
    unit = lambda x: np.array(x, float) / np.linalg.norm(x)
    held = {i: unit(x) for i, x in vectors.items()}
    out = set()
    for q, x in asked.items():
        best = sorted((-round(float(unit(x) @ v), 6), i) for i, v in held.items())[:k]
        out |= {(q, i, round(-s, 6), rank) for rank, (s, i) in enumerate(best, 1)}
    return out


def rounded(rows):
    return {(r[0], r[1], round(r[2], 6), r[3]) for r in rows}


def test_every_twentieth_row_is_asked(spark, sf):
    held = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(held, {i: x for i, x in held.items() if i % 20 == 0}, 50)
    got = queries.QUERIES["dense_topk"](spark, sf).select("query_id", "vec_id", "score", "rank").collect()
    assert len({r.query_id for r in got}) > 10 and len(got) == len(want)
    assert rounded(got) == want


def test_several_blocks_and_ties(spark):
    n = 300
    rng = np.random.default_rng(4)
    asked = {i: rng.integers(-2, 3, size=6).tolist() for i in range(n)}
    held = {i: rng.integers(-1, 2, size=6).tolist() for i in range(400)}
    asked, held = ({i: [float(c) for c in x] for i, x in rows.items() if any(x)} for rows in (asked, held))
    table = lambda rows, key: spark.createDataFrame([*rows.items(), (None, None)], f"{key} long, v array<double>").repartition(3)
    got = dense.search(table(held, "id"), table(asked, "qid").withColumnRenamed("v", "q"), "id", "v", "qid", "q", k=3, block_bytes=48 * 100)
    rows = got.collect()
    assert len(rows) == 3 * len(asked) and rounded(rows) == brute(held, asked, 3)


def test_vectors_of_two_texts(spark):
    rows = [("a", "One", ["two"], "full two"), ("b", "", [], "x"), ("c", None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, short string, key array<string>, enriched_text string")
    got = {r.chunk_id: r for r in dense.build_vectors(chunks).collect()}
    assert abs(sum(x * x for x in got["a"].summary) - 1) < 1e-9 and sum(x > 0 for x in got["a"].summary) == 2
    assert not any(got["b"].summary) and max(got["b"].full) == 1.0 and not any(got["c"].full)
