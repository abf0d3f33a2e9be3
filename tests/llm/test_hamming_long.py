"""Vectors of more than 64 components against all distances."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import hamming


def test_all_components_count(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 150))
    v[60:] = v[:60] * np.where(rng.random((60, 150)) < 0.05, -1, 1)
    v[:, :64] = v[0, :64]  # the first words are alike
    rows = [(i, x[: (150, 70, 40)[i % 3]].tolist()) for i, x in enumerate(v)]
    bits = {i: np.pad(np.array(x) > 0, (0, 150 - len(x))) for i, x in rows}
    want = set()
    for q in range(0, 120, 5):
        near = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items() if i != q)[:7]
        want |= {(q, i, d, place) for place, (d, i) in enumerate(near, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in hamming.nearest(df, F.col("id") % 5 == 0, k=7).collect()} == want
