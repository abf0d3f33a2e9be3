"""Operator 3: suffix-array deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that a ``length``-byte string covers is removed if that string also starts anywhere else in the corpus.

Blocks. All equal windows (strings of ``length`` bytes) hold the same least-hashed ``GRAM``-byte string, at the same place:
their anchor. Windows in a row with one anchor are one piece of text. Anchors that occur once cannot be in a repeat, and go
after a count of hashes; of the others, equal pieces are counted as one. So only different pieces around one anchor are
compared, all of them in one block. An anchor with more than ``GROUP`` different pieces is split: its windows are halved by
their place against the anchor, and each half is dealt by the bytes that all its windows share, until groups are small or equal.

In a block. The pieces are concatenated and transformed; then intervals of the transform are extended backwards, breadth
first. A boundary between two suffixes that a level sets for the first time has that level as its longest common prefix, so
these are found by increasing value, and the search stops at ``length``: boundaries that are still unset join suffixes with
``length`` bytes or more in common.

The removed spans are joined to their documents, and what is left is hashed. Memory: one block, or one document.

Defined results: a null text is empty. Texts shorter than ``length`` lose nothing. Repeated rows and equal texts of at least
``length`` bytes remove each other whole. Matches never cross documents. Rows are known by (doc_id, hash of the text); a null
doc_id is one more id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Scratch, columns_or_null, mix, pieces, powers, split_join, trimmed
from .decontaminate import ranges

LENGTH = 400
#: Bytes of an anchor.
GRAM = 96
#: Different pieces of one anchor that are compared in one block.
GROUP = 2000
#: An anchor, or a piece, with more copies than this is joined without dealing its rows by it.
MANY = 10_000
#: Bytes of a block.
BLOCK_BYTES = 1 << 20
#: Symbols of the first sort key, nine bits each.
PACKED = 7


def digest(x) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width``."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if width > have else out


def anchored(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, place of the anchor, anchor's hash) of every piece; places are in ``data``."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[gram:] - total[: n + 1 - gram]) * down[: n + 1 - gram])
    ordered = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # ties: the first
    place = (sliding_least(ordered, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + length <= offsets[row + 1]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(change & inside)
    # windows of a row that reach beyond it come last, so a piece ends before the next change or the first of those
    stop = np.flatnonzero(np.concatenate([change | ~inside, [True]]))
    windows = stop[np.searchsorted(stop, first, "right")] - first
    return row[first], first, windows, place[first], grams[place[first]]


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least ``depth`` symbols (prefix doubling from packed symbols); ends count as smallest."""
    n = len(codes)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key = (key << 9) | padded[j : j + n]
    have = PACKED
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if have >= depth or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] if have < n else 0
        key = rank * (n + 1) + after
        have *= 2


def far_boundaries(transform: np.ndarray, length: int) -> np.ndarray:
    """For each boundary between neighbours in suffix order: True if they have ``length`` symbols or more in common."""
    n = len(transform)
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    change = np.concatenate([[True], transform[1:] != transform[:-1]])
    run_of = np.cumsum(change) - 1
    run_first = np.flatnonzero(change)
    run_last = np.concatenate([run_first[1:], [n]])
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        r0, r1 = run_of[lo], run_of[hi - 1] + 1
        run, of = ranges(r0, r1), np.repeat(np.arange(len(lo)), r1 - r0)
        first, last = np.maximum(run_first[run], lo[of]), np.minimum(run_last[run], hi[of])
        symbol = transform[first].astype(np.int64)
        least, most = step[first], step[last - 1] + 1
        if len(run) > len(lo):  # several runs of one symbol in an interval are one extension
            key = of * 512 + symbol
            by = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
            end = np.concatenate([new[1:], [len(by)]]) - 1
            least, most = least[by[new]], most[by[end]]
        fresh = unset[most]
        lo, hi = least[fresh], most[fresh]
        unset[hi] = False
    return unset


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows start elsewhere too, in any of the texts."""
    data = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = data.astype(np.uint16) + 2
    codes[begins + sizes] = 1  # no window of a text holds it
    codes[-1] = 0
    order = suffix_order(codes, length)
    far = far_boundaries(codes[order - 1], length)
    hit = np.zeros(len(codes), bool)
    hit[order[far[:-1] | far[1:]]] = True
    return [hit[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes, strict=True)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(z) - 1) for a, z in zip(edge[::2], edge[1::2], strict=True)]


PIECE = "doc long, hash long, first int, windows int, off int, anchor long, same long"
PART = "key long, anchor long, same long, windows int, off int, times long, low int, high int, at int, own int, part long, data binary"
SPAN = "anchor long, same long, windows int, off int, s int, e int"


def _pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offsets in pieces(b):
                row, first, windows, place, anchor = anchored(data, offsets, length, gram)
                view = memoryview(data)
                same = [digest(view[a : a + w + length - 1]) for a, w in zip(first.tolist(), windows.tolist(), strict=True)]
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(at), b.column(2).take(at), pa.array((first - offsets[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(same, pa.int64())],
                    names=["doc", "hash", "first", "windows", "off", "anchor", "same"],
                )

    return rows.select("text", "doc", "hash").mapInArrow(trimmed(cut), PIECE)


def _texts(rows: DataFrame, scratch: Scratch, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes of one copy of each piece. wanted: anchor, same, windows, off, times and from (doc, hash, first)."""
    by_doc = scratch.table(wanted.groupBy("from.doc", "from.hash").agg(F.collect_list(F.struct(F.col("from.first").alias("first"), "anchor", "same", "windows", "off", "times")).alias("wants")))
    joined = rows.join(by_doc, ["doc", "hash"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                raw, wants = text.as_buffer(), wanted.as_py()
                out = [(x["anchor"], x["anchor"], x["same"], x["windows"], x["off"], x["times"], gram - length, 0, 0, x["windows"], x["same"], raw[x["first"] : x["first"] + x["windows"] + length - 1].to_pybytes()) for x in wants]
                yield pa.RecordBatch.from_pylist([dict(zip(_names(PART), r, strict=True)) for r in out], _arrow(PART))

    return joined.select("text", "wants").mapInArrow(trimmed(take), PART)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _halves(parts: DataFrame, length: int) -> DataFrame:
    """Each part's windows in two, by their place against the anchor, dealt by the bytes that all windows of a half share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.to_pylist():
                middle = (x["low"] + x["high"]) // 2
                for low, high in ((x["low"], middle), (middle + 1, x["high"])):
                    a, z = max(x["at"], low + x["off"]), min(x["at"] + x["own"] - 1, high + x["off"])
                    if a <= z:
                        data = x["data"][a - x["at"] : z - x["at"] + length]
                        begin = a - x["off"]
                        key = digest(data[high - begin : low + length - begin] + repr((x["anchor"], low, high)).encode())
                        out.append(x | {"key": key, "low": low, "high": high, "at": a, "own": z - a + 1, "part": digest(data), "data": data})
            if out:
                yield pa.RecordBatch.from_pylist(out, _arrow(PART))

    return parts.select(*_names(PART)).mapInArrow(trimmed(split), PART)


def _blocks(parts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows; rows must come sorted by key."""

    def solve(group: list[dict]) -> pa.RecordBatch:
        out = []
        for x, flags in zip(group, repeated_windows([x["data"] for x in group], length), strict=True):
            if x["times"] > 1:
                flags = np.ones(x["own"], bool)
            out += [(x["anchor"], x["same"], x["windows"], x["off"], x["at"] + a, x["at"] + z) for a, z in runs_of(flags)]
        return pa.RecordBatch.from_pylist([dict(zip(_names(SPAN), r, strict=True)) for r in out], _arrow(SPAN))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.to_pylist():
                if size >= BLOCK_BYTES and x["key"] != held[-1]["key"]:  # whole groups only
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x["data"])
        if held:
            yield solve(held)

    return parts.select(*_names(PART)).mapInArrow(trimmed(search), SPAN)


def repeated_spans(scratch: Scratch, rows: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """doc, hash, s, e: byte ranges of the documents to remove. They may overlap."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.table(_pieces(rows, length, gram))
    counted = cut.groupBy("anchor").agg(F.count("*").alias("n"), F.min("same").alias("x"), F.max("same").alias("y")).filter("n > 1")
    # one kind of piece only: all of its copies repeat each other
    counted = scratch.table(counted.select("anchor", "n", (F.col("x") == F.col("y")).alias("equal")))
    found = scratch.table(split_join(scratch, cut, counted.select("anchor", "equal"), ["anchor"], counted.filter(F.col("n") > MANY)))
    scratch.drop(cut, counted)
    whole = found.filter("equal").select("doc", "hash", F.col("first").alias("s"), (F.col("first") + F.col("windows") - 1 + length).alias("e"))
    mixed = found.filter("not equal")
    which = ["anchor", "same", "windows", "off"]
    kinds = scratch.table(mixed.groupBy(*which).agg(F.count("*").alias("times"), F.min(F.struct("doc", "hash", "first")).alias("from")))
    parts = scratch.table(_texts(rows, scratch, kinds, length, gram))
    spans = []
    while True:
        sums = parts.groupBy("key").agg(F.sum("times").alias("all"), F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).filter("all > 1")
        level = parts.join(sums.select("key", "n", (F.col("x") == F.col("y")).alias("equal")), "key")
        spans.append(level.filter("equal").select(*which, F.col("at").alias("s"), (F.col("at") + F.col("own") - 1).alias("e")))
        small = level.filter(f"not equal and n <= {group}").repartition(n_parts, "key").sortWithinPartitions("key")
        spans.append(scratch.table(_blocks(small, length)))
        hot = level.filter(f"not equal and n > {group}")
        if not sums.filter(f"x <> y and n > {group}").limit(1).count():
            break
        parts = scratch.table(_halves(hot, length))
    known = spans[0]
    for x in spans[1:]:
        known = known.unionByName(x)
    known = scratch.table(known.distinct())
    again = split_join(scratch, mixed, known, which, kinds.filter(F.col("times") > MANY)).select("doc", "hash", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e") + length).alias("e"))
    return whole.unionByName(again)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left, of every row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = columns_or_null(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))
    spans = repeated_spans(scratch, rows, length, gram, group)
    by_doc = scratch.table(spans.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans")))
    scratch.keep_only(by_doc)
    joined = rows.join(by_doc, ["doc", "hash"], "left")
    schema = _arrow(KEPT)

    def left_of(raw: memoryview, cuts: list[dict]) -> tuple[int, int, int, str, bytes]:
        kept, at, gone, runs, edge = [], 0, 0, 0, -1
        for c in cuts:
            s, e = c["s"], c["e"]
            if s > edge:
                runs += 1
                kept.append(raw[at:s])
                gone += e - s
                at = edge = e
            elif e > edge:
                gone += e - edge
                at = edge = e
        kept.append(raw[at:])
        rest = b"".join(kept)
        return len(raw), gone, runs, hashlib.sha256(rest).hexdigest(), rest

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i in range(b.num_rows):
                out.append((b.column(0)[i].as_py(), *left_of(memoryview(b.column(1)[i].as_buffer()), b.column(2)[i].as_py() or ())))
                size += out[-1][1]
                if size >= PIECE_BYTES or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0

    return joined.select("doc_id", "text", "spans").mapInArrow(trimmed(apply), KEPT)
