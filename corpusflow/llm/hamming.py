"""Operator 8: exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, and every segment has a table of its own. A search looks up, in table after table, the values
within a small radius of its own segments, and verifies the codes found by their whole distance. When segments 0..s were
searched at radius r and the others at r - 1, every code within m * r + s has been seen; a query ends once its kth
distance is within that, so its result is proven exact. Otherwise the radius grows.

Index and queries meet in blocks of bounded size: each task has one block of codes (with its tables) and one of queries, and
returns each query's best; their union holds the best of all. Equal codes are one entry with its smallest ids, so copies of one
vector, however many, cost no more than one.

Defined results: a null vector has no code, and a row with a null id no name: neither is found nor a query. Null or NaN components count as not positive. The
code has the signs of all components, in words of 64 bits; a shorter vector's further bits are 0. A query is not its own neighbour, but other rows with equal vectors are; ties go
to the smaller id. Rows with one id and code are one entry. Empty tables give no rows; fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, trimmed
from .decontaminate import ranges

#: Bits of a word of a code.
BITS = 64
#: Codes and queries that one task holds at most, but for hashing's unevenness.
BLOCK_CODES, BLOCK_QUERIES, LEAST_BLOCKS = 200_000, 20_000, 8
#: Table entries looked at in one step.
STEP = 1 << 20


def sign_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, code (binary: words of 64 bits, without zero words at the end but for the first)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            size = np.asarray(pa.compute.list_value_length(lists).fill_null(0))
            n_words = max(1, -(-int(size.max(initial=0)) // BITS))
            positive = np.zeros((len(lists), n_words * BITS), bool)
            flat = lists.flatten().to_numpy(zero_copy_only=False) > 0
            row = np.repeat(np.arange(len(lists)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            positive[row, place] = flat
            packed = np.packbits(positive, axis=1)
            used = np.maximum(1, ((packed.view(">u8") != 0) * np.arange(1, n_words + 1)).max(1, initial=1)) * (BITS // 8)
            codes = [x[:n].tobytes() for x, n in zip(packed, used, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], names=["id", "code"])

    return columns_or_null(vectors, **{id_column: "long", vector_column: "array<double>"}).filter(f"`{vector_column}` is not null and `{id_column}` is not null").mapInArrow(trimmed(encode), "id long, code binary")


def unpacked(codes: list[bytes], n_words: int) -> np.ndarray:
    """A row of words for each code."""
    size = n_words * BITS // 8
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in codes), ">u8").astype(np.uint64).reshape(-1, n_words)


def _patterns(width: int, radius: int) -> np.ndarray:
    values = np.arange(1 << width, dtype=np.uint64)
    return values[np.bitwise_count(values) == radius]


def search_block(codes: np.ndarray, least_id: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code, distance) of each query's k nearest codes, ties by least_id; exact. Codes and queries: words, or rows of words."""
    n = len(codes)
    codes, queries = (x.reshape(-1, 1) if x.ndim == 1 else x for x in (codes, queries))
    if not n or not len(queries):
        return (np.zeros(0, np.int64),) * 3
    m = max(4, round(BITS / max(4, np.log2(n))))
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    shifts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.uint64)
    n_words = codes.shape[1]
    word = np.repeat(np.arange(n_words), m)  # no segment lies in two words
    m, widths, shifts = m * n_words, widths * n_words, np.tile(shifts, n_words)
    tables = []
    for at, width, shift in zip(word, widths, shifts, strict=True):
        part = (codes[:, at] >> shift) & np.uint64((1 << width) - 1)
        order = np.argsort(part, kind="stable")
        tables.append((order, np.searchsorted(part[order], np.arange((1 << width) + 1, dtype=np.uint64))))
    q_found, c_found, d_found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.full(len(queries), BITS * n_words + 1)
    active = np.arange(len(queries))
    for radius in range(max(widths) + 1):
        for s in range(m):
            if radius <= widths[s]:
                order, starts = tables[s]
                flips = _patterns(widths[s], radius)
                own = (queries[active, word[s]] >> shifts[s]) & np.uint64((1 << widths[s]) - 1)
                fresh = []
                per = max(1, STEP // len(flips))
                for lo in range(0, len(active), per):
                    values = (own[lo : lo + per, None] ^ flips[None, :]).astype(np.int64)
                    first, last = starts[values], starts[values + 1]
                    held = last > first
                    q = np.broadcast_to(active[lo : lo + per, None], values.shape)[held]
                    c = order[ranges(first[held], last[held])]
                    q = np.repeat(q, (last - first)[held])
                    d = np.bitwise_count(queries[q] ^ codes[c]).sum(1, dtype=np.int64)
                    near = d <= kth[q]
                    fresh.append((q[near], c[near], d[near]))
                if sum(len(x[0]) for x in fresh):
                    q, c, d = (np.concatenate([old, *(x[i] for x in fresh)]) for i, old in enumerate((q_found, c_found, d_found)))
                    once = np.unique(q * n + c, return_index=True)[1]
                    q, c, d = q[once], c[once], d[once]
                    by = np.lexsort((least_id[c], d, q))
                    q, c, d = q[by], c[by], d[by]
                    begins = np.searchsorted(q, np.arange(len(queries)))
                    place = np.arange(len(q)) - begins[q]
                    kth[q[place == k - 1]] = d[place == k - 1]
                    q_found, c_found, d_found = q[place < k], c[place < k], d[place < k]
            active = active[kth[active] > m * radius + s]
            if not len(active):
                return q_found, c_found, d_found
    return q_found, c_found, d_found


def nearest(vectors: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, neighbour_id, distance and place (1 .. k) of each row where ``is_query`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hamming")
    coded = scratch.table(sign_codes(vectors, id_column, vector_column))
    queries = coded.filter(is_query).distinct()
    first_ids = coded.distinct().withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("id"))).filter(F.col("place") <= k + 1)
    entries = scratch.table(first_ids.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # k + 1 ids at most
    asked = scratch.table(queries.select("code").distinct())
    code_blocks = max(LEAST_BLOCKS, -(-entries.count() // BLOCK_CODES))
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("code", F.lit(5)), F.lit(n)).cast("int")
    left = entries.select(block(code_blocks).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("j"), "code", F.element_at("ids", 1).alias("least"))
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))).alias("i"), block(query_blocks).alias("j"), "code")

    def meet(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        own, q = codes["code"].to_pylist(), wanted["code"].to_pylist()
        n_words = max((len(x) for x in own + q), default=8) * 8 // BITS
        at, c, d = search_block(unpacked(own, n_words), codes["least"].to_numpy(), unpacked(q, n_words), k + 1)
        return pa.table({"asked": pa.array([q[i] for i in at], pa.binary()), "code": pa.array([own[i] for i in c], pa.binary()), "distance": d.astype(np.int32)})

    tasks = min(10_000, code_blocks * query_blocks)  # a number that is given stays: small blocks are long work
    left, right = (x.repartition(tasks, "i", "j") for x in (left, right))
    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, "asked binary, code binary, distance int")
    best = met.join(entries, "code").select("asked", "distance", F.explode("ids").alias("neighbour_id"))
    best = scratch.table(best.withColumn("place", F.row_number().over(W.partitionBy("asked").orderBy("distance", "neighbour_id"))).filter(F.col("place") <= k + 1))
    pairs = queries.join(best.drop("place"), F.col("code") == F.col("asked")).filter(F.col("id") != F.col("neighbour_id"))
    placed = pairs.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour_id"))).filter(F.col("place") <= k)
    return placed.select(F.col("id").alias("query_id"), "neighbour_id", "distance", "place")
