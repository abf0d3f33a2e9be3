"""Operator 1: sharding by a K-d tree. Nodes are split at distributed weighted medians along their widest metadata dimension.

Every node holds a number of leaves still to be made; it is split in two at the weighted quantile that gives each side its
share of the bytes (the median, where the leaves halve evenly), until each node is one leaf of the target size. The widest
dimension is the one whose extent in the node is the largest part of its extent in the whole table.

A quantile is found by passes over the narrow metadata table: each pass sums bytes into ``BUCKETS`` equal ranges of the sort key
for all nodes of a level at once, and narrows each node's range to the bucket where its quota falls. Only those sums (nodes x
BUCKETS rows at most, whatever the input) reach the driver. The sort key is the dimension's value, then a hash of the text, so
that a source, language or length with a third of all rows is split as finely as any other, and copies of a text with equal
metadata lie next to each other: they share a shard unless a cut falls among them, as it must where they outgrow a leaf. Rows
with equal keys are split by a hash of their doc_id, and repeated rows by their number in the scratch table.

Defined results: a null text has size ``overhead`` and the checksum of the empty text. A null doc_id is one more id. Texts are read
for their size and hashes only, however long they are; one that is larger than a leaf makes a larger shard. Null dimensions are the smallest value.
An empty table gives no rows. Extra columns are ignored. With fewer rows than leaves some leaves stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch, columns_or_null, extended, running_totals, trimmed

BUCKETS = 4096
#: Passes stop when the bucket that holds the quota has less than this part of a leaf's bytes.
TOLERANCE = 0.002
#: A dimension's value has 31 bits, the hash after it 31 more.
DIM_BITS = 31
LAST_UID = (1 << 62) - 1
DIMENSIONS = ("d_length", "d_source", "d_lang")


@dataclass
class Node:
    leaves: int
    first_leaf: int = 0
    dimension: str | None = None
    #: The left side: (key, row number) before or at this.
    cut: tuple[int, int] = (0, 0)
    sides: list[Node] = field(default_factory=list)


@dataclass
class Search:
    """The narrowing range of one node's quantile. ``fixed``: the key is settled, and row numbers are being searched."""

    node: Node
    lo: int
    hi: int
    quota: float
    fixed: int | None = None

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BUCKETS))


COLUMNS = ("size", *DIMENSIONS, "tie", "uid")


def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in COLUMNS}


def sort_key(x: dict[str, np.ndarray], dimension: str) -> np.ndarray:
    return (x[dimension] << DIM_BITS) + x["tie"]


def locate(x: dict[str, np.ndarray], tree: dict[int, Node]) -> np.ndarray:
    """The node of every row: children of node k are 2k + 1 and 2k + 2."""
    at = np.zeros(len(x["size"]), np.int64)
    for k in sorted(tree):
        n = tree[k]
        if n.dimension and n.sides:
            here = np.flatnonzero(at == k)
            key, uid = sort_key({c: x[c][here] for c in (n.dimension, "tie")}, n.dimension), x["uid"][here]
            left = (key < n.cut[0]) | ((key == n.cut[0]) & (uid <= n.cut[1]))
            at[here] = 2 * k + np.where(left, 1, 2)
    return at


def metadata(docs: DataFrame, overhead: int) -> DataFrame:
    """The narrow table that the tree is built on: one row per document, without its text."""
    rows = columns_or_null(docs, doc_id="long", text="string", lang="string", source="string")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = lambda c: F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 64 - DIM_BITS + 1) + 1, F.lit(0))
    return rows.select(
        "doc_id",
        (F.length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("source").isNull(), 0).otherwise(name("source")).cast("long").alias("d_source"),
        F.when(F.col("lang").isNull(), 0).otherwise(name("lang")).cast("long").alias("d_lang"),
        (F.log2(F.length(text) + F.lit(1.0)) * (1 << 25)).cast("long").alias("d_length"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - DIM_BITS).alias("tie"),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - DIM_BITS), DIM_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - DIM_BITS)).alias("uid"),
    )


def _extents(rows: DataFrame, tree: dict[int, Node]) -> dict[int, Row]:
    """Bytes and extents of the tree's leaves so far: a row for each."""
    ends = [f"{e}_{d}" for d in DIMENSIONS for e in ("least", "most")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = columns_of(b)
            at = locate(x, tree)
            own = np.unique(at)
            groups = [np.flatnonzero(at == k) for k in own]
            out = [pa.array(own), pa.array([int(x["size"][g].sum()) for g in groups])]
            out += [pa.array([int((x[d][g].min if e == "least" else x[d][g].max)()) for g in groups]) for d in DIMENSIONS for e in ("least", "most")]
            yield pa.RecordBatch.from_arrays(out, names=["node", "size", *ends])

    found = rows.select(*COLUMNS).mapInArrow(trimmed(measure), "node long, size long, " + ", ".join(f"{e} long" for e in ends))
    return {r["node"]: r for r in found.groupBy("node").agg(F.sum("size").alias("size"), *((F.min if e.startswith("least") else F.max)(e).alias(e) for e in ends)).collect()}


def _histogram(rows: DataFrame, tree: dict[int, Node], searches: dict[int, Search]) -> dict[int, dict[int, int]]:
    """Bytes by bucket of each search's range."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(BUCKETS, np.int64) for k in searches}
        for b in batches:
            x = columns_of(b)
            at = locate(x, tree)
            for k, s in searches.items():
                here = np.flatnonzero(at == k)
                value = sort_key({c: x[c][here] for c in (s.node.dimension, "tie")}, s.node.dimension)
                if s.fixed is not None:
                    here = here[value == s.fixed]
                    value = x["uid"][here]
                near = (value >= s.lo) & (value <= s.hi)
                np.add.at(total[k], (value[near] - s.lo) // s.step, x["size"][here[near]])
        for k, sums in total.items():
            full = np.flatnonzero(sums)
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k)), pa.array(full), pa.array(sums[full])], names=["node", "bucket", "size"])

    out: dict[int, dict[int, int]] = {}
    for r in rows.select(*COLUMNS).mapInArrow(trimmed(fill), "node long, bucket long, size long").groupBy("node", "bucket").agg(F.sum("size").alias("size")).collect():
        out.setdefault(r["node"], {})[r["bucket"]] = r["size"]
    return out


def _find_cuts(rows: DataFrame, tree: dict[int, Node], searches: dict[int, Search], leaf_bytes: float) -> None:
    """Sets the cut of every node in ``searches``."""
    while searches:
        by_node = _histogram(rows, tree, searches)
        for k, s in list(searches.items()):
            seen, chosen = 0, None
            for b in sorted(by_node.get(k, {})):
                if seen + by_node[k][b] >= s.quota:
                    chosen = b
                    break
                seen += by_node[k][b]
            if chosen is None:  # nothing is left in this range: all of it goes to the left
                s.node.cut = (s.hi, LAST_UID) if s.fixed is None else (s.fixed, s.hi)
                del searches[k]
                continue
            lo, size = s.lo + chosen * s.step, by_node[k][chosen]
            hi, left = min(s.hi, lo + s.step - 1), s.quota - seen
            if size <= TOLERANCE * leaf_bytes or (s.step == 1 and s.fixed is not None):
                end = hi if left * 2 >= size else lo - 1
                s.node.cut = (end, LAST_UID) if s.fixed is None else (s.fixed, end)
                del searches[k]
            elif s.step == 1:  # many rows share this key
                searches[k] = Search(s.node, 0, LAST_UID, left, fixed=lo)
            else:
                searches[k] = Search(s.node, lo, hi, left, s.fixed)


def build_tree(rows: DataFrame, leaves: int) -> dict[int, Node]:
    """The nodes by number."""
    tree = {0: Node(leaves)}
    level, whole = [0], None
    while level:
        seen = _extents(rows, tree)
        whole = whole or seen.get(0)
        searches: dict[int, Search] = {}
        for k in level:
            node, r = tree[k], seen.get(k)
            if r is None or node.leaves == 1:
                continue
            spread = lambda d, r=r: (r[f"most_{d}"] - r[f"least_{d}"]) / max(1, whole[f"most_{d}"] - whole[f"least_{d}"])
            node.dimension = max(DIMENSIONS, key=spread)
            lo, hi = r[f"least_{node.dimension}"] << DIM_BITS, ((r[f"most_{node.dimension}"] + 1) << DIM_BITS) - 1
            searches[k] = Search(node, lo, hi, r["size"] * (node.leaves // 2) / node.leaves)
        split = list(searches)
        _find_cuts(rows, tree, searches, max(1.0, (whole["size"] if whole else 0) / leaves))
        level = []
        for k in split:
            node, left = tree[k], tree[k].leaves // 2
            node.sides = [Node(left, node.first_leaf), Node(node.leaves - left, node.first_leaf + left)]
            tree[2 * k + 1], tree[2 * k + 2] = node.sides
            level += [2 * k + 1, 2 * k + 2]
    return tree


def place(rows: DataFrame, tree: dict[int, Node]) -> DataFrame:
    """Adds the column shard."""
    schema = extended(rows.schema, shard="int")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.array([tree[k].first_leaf for k in locate(columns_of(b), tree)], np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=schema.fieldNames())

    return rows.mapInArrow(trimmed(put), schema)


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard of every document.

    Give the number of shards, or the bytes that a shard should reach.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kdtree")
    rows = scratch.table(metadata(docs, overhead))
    if shards is None:
        total = rows.agg(F.sum("size")).collect()[0][0] or 0
        shards = max(1, round(total / target_bytes))
    placed = place(rows, build_tree(rows, shards)).select("doc_id", "size", "text_crc32", "shard", "tie", "uid", F.lit(1).cast("long").alias("one"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = running_totals(scratch, placed, "shard", ["tie", "doc_id", "uid"], "one", partitions)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("total") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
