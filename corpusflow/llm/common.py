"""Shared pieces of the training-data operators: scratch tables, running totals, text hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch, drop_path, shared_dir

__all__ = ["Scratch", "drop_path", "shared_dir"]

#: Rows of one Arrow batch are worked on in pieces of about so many bytes of text: arrays over a piece have 8 bytes for each of them.
PIECE_BYTES = 250_000


def _places(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str | None]]:
    """The table with columns c0, c1 ..., and for each name the column of exactly that name, else of one that differs in case only."""
    have = df.columns
    found = [have.index(c) if c in have else next((i for i, x in enumerate(have) if x.lower() == c.lower()), None) for c in names]
    return df.toDF(*(f"c{i}" for i in range(len(have)))), [None if i is None else f"c{i}" for i in found]


def columns_or_null(df: DataFrame, **types: str) -> DataFrame:
    """Exactly these columns, in this order, cast; a column that is missing is null. Extra columns go, also those whose names
    differ from these in case only."""
    plain, at = _places(df, list(types))
    return plain.select(*((F.lit(None) if x is None else F.col(x)).cast(t).alias(c) for x, (c, t) in zip(at, types.items(), strict=True)))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """These columns as they are; extra ones go, also those whose names differ in case only."""
    plain, at = _places(df, list(names))
    return plain.select(*(F.col(x).alias(c) for x, c in zip(at, names, strict=True)))


def extended(schema: T.StructType, **types: str) -> T.StructType:
    """A schema with further columns, by their SQL types."""
    return T.StructType([*schema.fields, *(T.StructField(c, T.DataType.fromDDL(t)) for c, t in types.items())])


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_bytes: int = 16 << 20, row_bytes: int = 64) -> DataFrame:
    """Join; ``small`` is broadcast only if its counted rows fit ``max_bytes``, else both sides are shuffled.

    ``small`` should be a scratch table, as it is counted first.
    """
    return big.join(F.broadcast(small) if small.count() * row_bytes <= max_bytes else small, on, how)


def split_join(scratch: Scratch, big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame, row_bytes: int = 64) -> DataFrame:
    """Inner join. ``hot`` holds the keys that very many rows of ``big`` have: these rows stay where they are and meet their
    partners by a checked broadcast, so that no task gets all rows of a key."""
    hot = scratch.table(hot.select(*on))
    if not hot.limit(1).count():
        return big.join(small, on)
    warm = scratch.table(checked_join(small, hot, on, "left_semi"))
    cold = checked_join(big, hot, on, "left_anti").join(checked_join(small, hot, on, "left_anti"), on)
    return cold.unionByName(checked_join(big, warm, on, row_bytes=row_bytes))


def trimmed(work):
    """A mapInArrow function that gives its task's memory back to the system at the end: Python workers live on, and what their
    allocators hold would add up on an executor."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


# --- running totals over a global order ---------------------------------------------------------


def running_totals(scratch: Scratch, df: DataFrame, group: str, order: list[str], value: str, partitions: int) -> DataFrame:
    """Adds ``total``: the inclusive running sum of ``value`` (long) within ``group``, in the given order.

    Rows are range-partitioned by (group, order), so that a group with most of the rows spans many tasks. Each task sums
    its own rows; only one row per (task, group) is needed to add what earlier tasks hold.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    fields = df.schema.fieldNames()
    schema = extended(df.schema, part="int", seg="int", local="long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seg, last, base = 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(fields.index(group)).to_pylist()
            v = b.column(fields.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            segs, local = np.empty(len(g), np.int32), np.empty(len(g), np.int64)
            cuts = [0, *(i for i in range(1, len(g)) if g[i] != g[i - 1]), len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if last is None or last[0] != g[lo]:
                    seg, base = seg + 1, 0
                last = (g[lo],)
                local[lo:hi] = np.cumsum(v[lo:hi]) + base
                base = int(local[hi - 1])
                segs[lo:hi] = seg
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(segs), pa.array(local)], names=[*fields, "part", "seg", "local"])

    placed = scratch.table(df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(sums), schema))
    # one row per (task, group); tasks are in order, and a group is one run of tasks
    tails = placed.groupBy("part", "seg", group).agg(F.max("local").alias("tail"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tails = tails.select("part", "seg", F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("before"))
    return placed.join(tails, ["part", "seg"]).select(*fields, (F.col("local") + F.col("before")).alias("total"))


# --- bytes and hashes of words ------------------------------------------------------------------

#: Odd constants of the hashes below (fixed values: 64-bit fractions of well-known irrational numbers).
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_kept_powers = cache(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0.. and its inverses modulo 2^64, at least n of each. Sizes are powers of two, and those for longer texts aren't kept."""
    size = 1 << max(16, (max(1, n) - 1).bit_length())
    return (_kept_powers if size <= 1 << 19 else _powers)(size)


def space_bytes() -> np.ndarray:
    """True for the six ASCII space characters."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def punctuation_bytes() -> np.ndarray:
    """True for every ASCII byte that is neither a letter nor a digit."""
    t = np.zeros(256, bool)
    t[:128] = [not chr(i).isalnum() for i in range(128)]
    return t


def lower_bytes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of rows in them); null texts are empty. A row is never divided."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col) and col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; words don't cross rows."""
    inside = ~separator[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows, and for each row the number of its first word (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e = word_bounds(data, offsets, separator)
    up, down = powers(len(data) + 1)
    values = (lower_bytes()[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s]), np.searchsorted(s, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's run; ``first`` as from ``words``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def fold_of(doc_id: str, k: int):
    """crc32 of doc_id as text, modulo k; null: of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(k)).cast("int")


def bounded_sample(docs: DataFrame, labels: DataFrame | None, most_rows: int, most_bytes: int) -> DataFrame:
    """text, label, key of labelled documents: most_rows rows and most_bytes bytes of text at most, whatever the input holds.

    docs: doc_id, text (and label, where ``labels`` is None); labels: doc_id, label. Rows that are alike in all of these count
    once. Rows are taken in the order of a hash, the same on every run, until either bound is met; a text that the bytes
    left can't hold is passed over. Only narrow rows are joined and sorted; the texts taken are then fetched by a broadcast.
    """
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text")
    narrow = docs.filter("text is not null").select("doc_id", key.alias("key"), F.octet_length("text").cast("long").alias("size"), *(["label"] if labels is None else []))
    if labels is not None:
        narrow = narrow.join(labels, "doc_id")
    narrow = narrow.filter("label is not null").groupBy("key", "label").agg(F.max("size").alias("size"))
    first = narrow.orderBy(F.xxhash64("key", F.lit(5)), "label").limit(most_rows).collect()  # most_rows narrow rows
    taken, left = [], most_bytes
    for r in first:
        if r["size"] <= left:
            taken.append((r["key"], r["label"]))
            left -= r["size"]
    chosen = spark.createDataFrame(taken, T.StructType([T.StructField("key", T.LongType()), T.StructField("label", narrow.schema["label"].dataType)]))
    on = ["key"] if labels is not None else ["key", "label"]
    found = docs.select(key.alias("key"), "text", *on[1:]).join(F.broadcast(chosen), on)
    return found.groupBy("key", "label").agg(F.first("text").alias("text")).select("text", "label", "key")


def to_driver(df: DataFrame) -> pa.Table:
    """A table whose rows are bounded by a parameter of the caller."""
    return df.toArrow()
