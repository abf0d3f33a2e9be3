"""Exact neighbours against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hamming


def brute(codes, k):
    out = set()
    for q, own in codes.items():
        if q % 5 == 0:
            near = sorted((bin(own ^ c).count("1"), i) for i, c in codes.items() if i != q)[:k]
            out |= {(q, i, d, place) for place, (d, i) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_nearest(spark, monkeypatch, spread):
    monkeypatch.setattr(hamming, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    v = centres[rng.integers(0, 6, 300)] * (1 - spread) + rng.normal(size=(300, 64)) * (0.3 + spread)
    v[100:180] = v[0]
    codes = {i: int.from_bytes(np.packbits(x > 0).tobytes(), "big") for i, x in enumerate(v)}
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000, None, 1), (0, v[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = hamming.nearest(df, F.col("id") % 5 == 0, k=7)
    assert {tuple(r) for r in got.collect()} == brute(codes, 7)


def test_blocks_alone():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    q, c, d = hamming.search_block(codes, np.arange(len(codes)), codes[:20], 5)
    for i in range(20):
        dist = np.bitwise_count(codes[:20][i] ^ codes).astype(int)
        want = np.lexsort((np.arange(len(codes)), dist))[:5]
        assert c[q == i].tolist() == want.tolist()


def test_odd_vectors_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert hamming.nearest(spark.createDataFrame([], schema), F.col("id") % 20 == 0).count() == 0
    rows = [(0, [1.0, None, float("nan")]), (20, [1.0]), (40, []), (41, [-1.0] * 70), (None, [1.0])]
    got = {(r.query_id, r.neighbour_id, r.distance) for r in hamming.nearest(spark.createDataFrame(rows, schema), F.col("id") % 20 == 0, k=2).collect()}
    assert got == {(0, 20, 0), (0, 40, 1), (20, 0, 0), (20, 40, 1), (40, 41, 0), (40, 0, 1)}
