"""Exact inner-product search over the two vector indexes of the enriched chunks, one of summaries and one of full texts.

Queries are broadcast in blocks of a fixed number of bytes. A task multiplies each Arrow batch of vectors with a block and keeps
its own k best of each query, so k rows per query and task go on, not a row per query and vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V
from ..models import Embedder, word_counts
from . import dedup
from .best import Best

#: Bytes of the queries in one broadcast block (8 a component).
BLOCK_BYTES = 32 << 20
#: Scores worked out at once.
SCORES = 4_000_000


def summary_text(short: Column, key: Column) -> Column:
    """What the summary index holds of a chunk: the short summary and the key points."""
    return X.strip(F.concat_ws(" ", F.coalesce(short, F.lit("")), F.array_join(key, " ")))


def build_vectors(enriched: DataFrame, embed: Embedder = word_counts) -> DataFrame:
    """chunk_id, summary, full: both vectors of unit length. Write it as Parquet to keep it."""
    texts = enriched.select("chunk_id", summary_text(F.col("short"), F.col("key")).alias("_short"), F.coalesce("enriched_text", F.lit("")).alias("_full"))
    return texts.select("chunk_id", V.normalise(embed(F.col("_short"))).alias("summary"), V.normalise(embed(F.col("_full"))).alias("full"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _units(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=m.copy(), where=length > 0)


def _block(corpus: DataFrame, asked: pa.Table, key: str, query_key: str, k: int, normalised: bool, schema: T.StructType) -> DataFrame:
    names = asked[query_key].combine_chunks()
    questions = matrix(asked["_q"].combine_chunks())
    sent = corpus.sparkSession.sparkContext.broadcast((names, _units(questions) if normalised else questions))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions = sent.value
        found = Best(names, query_key, key, k)
        step = max(1, SCORES // max(1, len(questions)))
        for b in batches:
            b = b.filter(pc.is_valid(b.column(1)))  # here, as a filter of the plan would work out a computed vector twice
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                vectors = matrix(some.column(1))
                if vectors.shape[1]:
                    found.add(some.column(0), np.round((_units(vectors) if normalised else vectors) @ questions.T, 6))
        yield from found.batches()

    return corpus.mapInArrow(best, schema)


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int = 50, normalised: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_key, key, score, rank. With ``normalised`` both sides are brought to unit length first. Null vectors match nothing."""
    corpus = vectors.select(F.col(key), F.col(vector).alias("_v"))
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_key), F.col(query_vector).alias("_q"))
    n, longest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("_q")), F.lit(1))).first()
    blocks = max(1, -(-n * longest * 8 // block_bytes))
    fields = {f.name: f.dataType for f in [*corpus.schema.fields, *asked.schema.fields]}
    schema = T.StructType([T.StructField(query_key, fields[query_key]), T.StructField(key, fields[key]), T.StructField("score", T.DoubleType())])
    parts = []
    for i in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i)
        parts.append(_block(corpus, some.toArrow(), key, query_key, k, normalised, schema))
    return dedup.top_k(reduce(DataFrame.unionByName, parts), [query_key], [F.col("score").desc(), F.col(key).asc()], k)
