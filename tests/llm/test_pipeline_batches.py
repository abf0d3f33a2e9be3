"""Long texts reach the workers of the pipeline in small batches."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_long_texts_come_in_small_batches(spark, tmp_path):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ef gh ', 10000)").alias("text"), F.lit("en").alias("lang")).coalesce(1)
    try:
        for _, stage in P.STAGES:
            spark.conf.set(NAME, "64m")
            stage(spark, docs.limit(1), "/root/testdata/sf0.001")
            got = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 100
            assert max(r.size for r in got) <= (2 << 20) + 130_000  # the row that reaches the bound
        spark.conf.set(NAME, "500000")  # a smaller bound of the session is kept
        P.STAGES[0][1](spark, docs.limit(1), "/root/testdata/sf0.001")
        assert spark.conf.get(NAME).startswith("500000")
    finally:
        spark.conf.unset(NAME)
