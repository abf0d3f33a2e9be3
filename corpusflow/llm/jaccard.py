"""Operator 10: exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds its distinct ``width``-word shingles as 64-bit hashes. Tokens have one global order: first those that a
count sketch over all documents takes for rare, then the frequent ones, each by hash. Two sets that are similar enough must share
a token within their prefixes of n - ceil(t * n) + 1 tokens; with l - 1 more tokens in each, they must share l. Each document
lengthens its prefix by the candidates that the sketch lets expect for its tokens, and a pair is verified only if it shares as
many prefix tokens as the smaller of its two l asks.

Equal sets are one class (by a 64-bit signature), so copies cost nothing more. Prefix tokens are shuffled once, packed in blocks
by ranges of the token hash (``token_lists``); tokens that only one class has go there. Within a token's list no full set of
pairs is made:
1. every class is paired with the list's pivot, the class whose tokens are commonest (a star; this is a group's middle).
   Promising pairs, and all pairs of pivots with more than MANY partners, are compared, and components are formed;
2. lists that lie in one component are done. In the others every pair that could still join two components is compared;
   ``open_pairs`` tells how groups around one pivot are kept from meeting as all pairs.
Verification compares whole sets. So components are exact (up to collisions of 64-bit hashes), while links inside a known
component are not listed.

Memory: one document's tokens, the sketch (``2 ** SKETCH_BITS`` counters), one slice of the lists (about SLICE_POSTINGS tokens;
tokens that the sketch counts HOT times or more are dealt by token and class) and, in verification, one set at a time. Classes
with very many partners are salted. All intermediate tables lie in the shared folder.

Defined results: null and empty texts have an empty set and link with nothing, not even with each other. Texts with fewer words
than ``width`` have one token, the whole sequence. A null doc_id is kept; the component is the least non-null doc_id in it.
Rows that repeat a doc_id are one row each in the result. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASE, MASK, Scratch, checked_join, columns_or_null, mix, pieces, space_bytes, trimmed, words
from .components import connected_components

SKETCH_BITS = 20
#: Slices in which partial sketches are summed.
SLICES = 64
#: A token is frequent if its counter is above the mean by so much, or by so many standard deviations.
FREQUENT, DEVIATIONS = 64, 6.0
#: A token costs nothing while its counter is above the mean by fewer standard deviations than this: that is chance.
CHANCE = 4.0
#: One more prefix token for each so many expected candidates of a document, up to MOST_MATCHES in all.
COST_OF_A_MATCH, MOST_MATCHES = 16, 16
#: Prefix tokens in a block of the shuffle, and in a slice of the lists.
BLOCK_POSTINGS, SLICE_POSTINGS = 250_000, 2_000_000
#: A token in so many documents by the sketch is dealt by class too.
HOT = 100_000
#: Partners of one class that one task compares with it.
SALT_ROWS = 256
#: A class with more partners than this is a hot pivot; all partners of one with more than MANY are compared with it.
FEW, MANY = 16, 64


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row its distinct tokens (sorted 64-bit hashes)."""
    h, first = words(data, offsets, space_bytes())
    factors = [np.uint64(pow(BASE, 3 * i + 1, 1 << 64)) for i in range(width)]
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i, f in enumerate(factors):
        whole += h[i : i + len(whole)] * f
    whole = mix(whole)
    out = []
    for a, z in zip(first, first[1:], strict=False):
        if z - a >= width:
            out.append(np.unique(whole[a : z - width + 1]))
        elif z > a:
            short = sum(int(x) * int(f) for x, f in zip(h[a:z], factors, strict=False)) + (int(z - a) << 40)
            out.append(mix(np.array([short & MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> int:
    """The class of a set: a hash of it."""
    whole = (int(mix(tokens + np.uint64(len(tokens))).sum(dtype=np.uint64)) + len(tokens)) & MASK
    return int(mix(np.array([whole], np.uint64)).view(np.int64)[0])


def commonness(expected: np.ndarray) -> int:
    """How common a set's tokens are, 0 to 127. The set in the middle of a large group of near copies has the commonest."""
    return min(127, int(8 * float(np.log2(1.0 + expected).mean())))


def _places(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(scratch: Scratch, rows: DataFrame, width: int) -> np.ndarray:
    """Documents by hashed token, over all documents; one vector of fixed size."""
    size = (1 << SKETCH_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for _, _, data, offsets in pieces(b):
                found = [t for t in shingles(data, offsets, width) if len(t)]
                if found:
                    np.add.at(total, _places(np.concatenate(found)), 1)
        if total.any():
            small = total.astype(np.uint16 if total.max() < 1 << 16 else np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([small[i * size : (i + 1) * size].tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint16 if len(x) == 2 * size else np.int64).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    parts = rows.select("text").mapInArrow(trimmed(count), schema).repartition(SLICES, "slice").mapInArrow(trimmed(add), schema)
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.toArrow().to_pylist():  # SLICES rows
        sketch[r["slice"] * size : (r["slice"] + 1) * size] += np.frombuffer(r["counts"], np.int64)
    return sketch


def prefix_tokens(tokens: np.ndarray, expected: np.ndarray, frequent: np.ndarray, tenths: int) -> tuple[np.ndarray, int]:
    """The lengthened prefix, and the shared tokens that it asks for (l). expected: candidates of each token by the sketch."""
    n = len(tokens)
    order = np.lexsort((tokens, frequent))
    least = n - (-(-tenths * n // 10)) + 1
    cost = float(expected[order[:least]].sum())
    matches = 1 + min(MOST_MATCHES - 1, int(cost / COST_OF_A_MATCH), n - least)
    return tokens[order[: least + matches - 1]], matches


@dataclass
class Sketch:
    """Expected documents of each hashed token, beyond chance, and the number from which a token is frequent."""

    over: np.ndarray
    frequent: float

    def expected(self, tokens: np.ndarray) -> np.ndarray:
        return self.over[_places(tokens)]

    def prefix(self, tokens: np.ndarray, tenths: int) -> tuple[np.ndarray, int]:
        over = self.expected(tokens)
        return prefix_tokens(tokens, over, over > self.frequent, tenths)


def sketch_of(scratch: Scratch, rows: DataFrame, width: int) -> Sketch:
    counts = count_sketch(scratch, rows, width)
    mean = counts.mean()
    over = np.where(counts > mean + CHANCE * mean**0.5, counts - mean, 0)
    return Sketch(over.astype(np.float32), max(FREQUENT, DEVIATIONS * mean**0.5))


SKETCHED = "doc_id long, text_key long, n long, sig long, matches int, common int, k int, hot binary, tokens binary"


def _sketched(scratch: Scratch, rows: DataFrame, sent, width: int, tenths: int, hot: int) -> DataFrame:
    """Every row's class, set size and prefix: ``tokens`` are k 64-bit hashes, ``hot`` has a byte for each. sent: the broadcast Sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                n, sig, matches, common, k, hots, tokens = ([] for _ in range(7))
                for t in shingles(data, offsets, width):
                    n.append(len(t))
                    over = sent.value.expected(t)
                    sig.append(signature(t) if len(t) else 0)
                    common.append(commonness(over) if len(t) else 0)
                    chosen, l = sent.value.prefix(t, tenths) if len(t) else (t, 0)
                    matches.append(l)
                    k.append(len(chosen))
                    hots.append((sent.value.expected(chosen) >= hot).tobytes())
                    tokens.append(chosen.tobytes())
                columns = [pa.array(n, pa.int64()), pa.array(sig, pa.int64()), *(pa.array(x, pa.int32()) for x in (matches, common, k)), pa.array(hots, pa.binary()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], *columns], names=["doc_id", "text_key", "n", "sig", "matches", "common", "k", "hot", "tokens"])

    return scratch.table(rows.select("text", "doc_id", F.xxhash64("text").alias("text_key")).mapInArrow(trimmed(work), SKETCHED))


def slice_of(token: np.ndarray, slices: int) -> np.ndarray:
    """Equal ranges of the token hash."""
    return ((token >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def token_lists(scratch: Scratch, sketched: DataFrame) -> DataFrame:
    """token, sig, pivot: the classes of every prefix token that more than one class has. The pivot has the commonest tokens.

    Prefix tokens travel once, as blocks of (slice, classes with their tokens). A hot token's classes are dealt over as many
    slices more by a hash of token and class, and meet by aggregation only.
    """
    spark = sketched.sparkSession
    total = sketched.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLICE_POSTINGS))

    def block(held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        once = list({x[0]: x for x in held}.values())  # equal sets have equal prefixes
        k = np.array([len(x[2]) for x in once])
        sig, common = np.array([x[0] for x in once], np.int64), np.array([x[1] for x in once], np.uint8)
        token, is_hot = np.frombuffer(b"".join(x[3] for x in once), np.uint64), np.frombuffer(b"".join(x[2] for x in once), bool)
        of = np.repeat(np.arange(len(once)), k)
        at = np.where(is_hot, slices + slice_of(mix(token ^ sig.view(np.uint64)[of]), slices), slice_of(token, slices))
        order = np.argsort(at, kind="stable")
        at, of, token = at[order], of[order], token[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))  # a class in a slice
        n = np.diff(np.concatenate([first, [len(at)]]))
        cut = np.flatnonzero(np.concatenate([[True], at[first][1:] != at[first][:-1]]))
        ends = np.concatenate([cut[1:], [len(first)]])
        sig, common, n = sig[of[first]], common[of[first]], n.astype(np.uint32)
        tokens = [token[first[i] : first[j] if j < len(first) else len(at)].tobytes() for i, j in zip(cut, ends, strict=True)]
        each = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(at[first][cut], pa.int32()), each(sig), each(common), each(n), pa.array(tokens, pa.binary())], names=["slice", "sigs", "commons", "counts", "tokens"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(x)
                size += len(x[2])
                if size >= BLOCK_POSTINGS:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    def lists_of(at: int, parts: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch | None:
        sigs, commons, counts, tokens = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*parts, strict=True), (np.int64, np.uint8, np.uint32, np.uint64), strict=True))
        of = np.repeat(np.arange(len(sigs), dtype=np.uint32), counts)
        if at < slices:  # most tokens occur once: they go before anything else is worked out
            order = np.argsort(tokens)
            again = tokens[order[1:]] == tokens[order[:-1]]
            twice = order[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
            tokens, of = tokens[twice], of[twice]
        if not len(tokens):
            return None
        sig, common = sigs[of], commons[of]
        order = np.lexsort((sig, common, tokens))
        sig, common, token = sig[order], common[order], tokens[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])
        sig, common, token = sig[new], common[new], token[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.concatenate([first, [len(token)]]))
        last = np.repeat(first + n - 1, n)
        kept = np.arange(len(token)) if at >= slices else np.flatnonzero(np.repeat(n, n) > 1)
        if not len(kept):
            return None
        columns = [token.view(np.int64)[kept], sig[kept], sig[last][kept], common[last][kept].astype(np.int32), np.full(len(kept), at >= slices)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "sig", "pivot", "common", "hot"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for at, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(at, []).append(x)
        for at in list(parts):
            if (out := lists_of(at, parts.pop(at))) is not None:
                yield out

    blocks = sketched.filter("n > 0").select("sig", "common", "hot", "tokens").mapInArrow(trimmed(pack), "slice int, sigs binary, commons binary, counts binary, tokens binary")
    found = scratch.table(blocks.repartitionById(slices, F.expr(f"slice % {slices}")).mapInArrow(trimmed(gather), "token long, sig long, pivot long, common int, hot boolean"))
    if not found.filter("hot").limit(1).count():
        return found.select("token", "sig", "pivot")
    hot = found.filter("hot").select("token", "sig", "pivot", "common")
    whole = hot.groupBy("token").agg(F.max_by("pivot", F.struct("common", "pivot")).alias("pivot"), F.min("sig").alias("x"), F.max("sig").alias("y")).filter("x <> y").select("token", "pivot")
    return found.filter("not hot").select("token", "sig", "pivot").unionByName(checked_join(hot.select("token", "sig"), scratch.table(whole), ["token"], row_bytes=24).select("token", "sig", "pivot"))


COMPARED = "a long, b long, linked boolean, inter int, whole boolean, held array<long>"


def compared(scratch: Scratch, pairs: DataFrame, classes: DataFrame, rows: DataFrame, sent, width: int, tenths: int) -> DataFrame:
    """Whole sets of each pair (a, b) compared: linked, the tokens in common, and what step 2 needs to know of b against a hot a.

    held: the prefix tokens of b that a has (only where a has more than FEW partners, else null). whole: b's tokens that a
    lacks are all in b's prefix, or none of its prefix tokens is held. pairs: a scratch table; a may be hot, partners are salted.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    involved = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    ids = scratch.table(involved.join(classes.select("sig", key.alias("key")), "sig"))
    found = checked_join(rows.withColumn("key", key), ids, ["key"], row_bytes=32).select("text", "sig")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # rows that share a doc_id may have other sets
            for lo, hi, data, offsets in pieces(b):
                want = b.column(1)[lo:hi].to_pylist()
                keep = [lo + i for i, t in enumerate(shingles(data, offsets, width)) if len(t) and signature(t) == want[i]]
                yield b.take(pa.array(keep, pa.int64()))

    texts = scratch.table(found.mapInArrow(trimmed(own), "text string, sig long"))
    salts = pairs.groupBy("a").agg(F.count("*").alias("partners")).withColumn("salts", F.ceil(F.col("partners") / SALT_ROWS).cast("int"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b", F.lit(3)), F.col("salts")).cast("int"))
    heads = salts.select(F.col("a").alias("sig"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "partners")
    needs = heads.unionByName(salted.select(F.col("b").alias("sig"), "a", "salt", "b", "partners"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = needs.join(texts, "sig").select("a", "salt", "b", "text", "partners").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of, done = np.zeros(0, np.uint64), None, None
        for b in batches:
            a, b_col, partners = (b.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for lo, _, data, offsets in pieces(b):
                for i, t in enumerate(shingles(data, offsets, width), lo):
                    if b_col[i] is None:
                        head, of = t, a[i]
                    elif of == a[i] and (a[i], b_col[i]) != done:
                        done = (a[i], b_col[i])
                        common = len(np.intersect1d(head, t, assume_unique=True))
                        held, whole = None, False
                        if partners[i] > FEW:
                            prefix = sent.value.prefix(t, tenths)[0]
                            mine = prefix[np.isin(prefix, head, assume_unique=True)]
                            held, whole = mine.view(np.int64).tolist(), not len(mine) or len(prefix) - len(mine) == len(t) - common
                        out.append((*done, 10 * common >= tenths * (len(head) + len(t) - common), common, whole, held))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "linked", "inter", "whole", "held"])

    out = scratch.table(together.select("text", "a", "b", "partners").mapInArrow(trimmed(compare), COMPARED))
    scratch.drop(texts)
    return out


def open_pairs(scratch: Scratch, lists: DataFrame, size: DataFrame, star: DataFrame, parts: DataFrame, tenths: int) -> DataFrame:
    """a, b: every pair that could still join two components, given the stars' comparisons.

    Lists in one component are done. In the others most classes of a large group are tied to one hot pivot p, which both
    hold at the list's token. Two classes tied to one p that share no token outside it have at most min(inter) tokens in
    common; if they need more, they must meet at a token outside p, so they aren't paired at p's own tokens. Those that need
    no more than min(inter) are found by their sizes instead.
    """
    main = star.filter("held is not null").groupBy("b").agg(F.max_by(F.struct(F.col("a").alias("p"), "inter", "whole", "held"), F.struct("inter", "a")).alias("m"))
    main = main.filter("m.whole and size(m.held) > 0").select(F.col("b").alias("sig"), "m.p", "m.inter", "m.held")
    placed = lists.select("token", "sig").join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    open_tokens = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    rows = placed.join(open_tokens, "token").withColumn("k", F.count("*").over(W.partitionBy("sig"))).join(size, "sig").join(main, "sig", "left")
    rows = scratch.table(rows.select("token", "sig", "component", "n", "matches", "k", "p", "inter", F.coalesce(F.array_contains("held", F.col("token")), F.lit(False)).alias("tied")))
    near = f"c_a <> c_b and 10 * least(n_a, n_b) >= {tenths} * greatest(n_a, n_b)"
    side = lambda df, s: df.select("token", *(F.col(c).alias(f"{c[0]}_{s}" if c not in ("sig", "matches") else {"sig": s, "matches": f"m_{s}"}[c]) for c in ("sig", "component", "n", "matches", "k", "p", "inter", "tied")))

    # n - ceil(t n) + m prefix tokens, of which n - c at most may be missing from the other set: true of the set whose prefix ends
    # first. Of two classes of one pivot all common tokens outside it were met: they must make up for what the pivot can't give.
    needed = f"(({tenths} * (n_a + n_b) + {tenths + 9}) div {10 + tenths})"
    bound = lambda x: f"{needed} - (({tenths} * n_{x} + 9) div 10) + m_{x}"
    asked = f"case when p_a = p_b then {needed} - least(i_a, i_b) else greatest(least(m_a, m_b), least({bound('a')}, {bound('b')})) end"
    # no pair shares more tokens than either has in open lists (k)
    near += f" and least(k_a, k_b) >= {asked}"

    # rows that are free of a pivot, with all others of their list; of one component's classes none meet
    free = side(rows.filter("not tied"), "a").join(side(rows, "b"), "token").filter(f"{near} and (t_b or a < b)")
    # rows tied to other pivots than most of their list
    usual = rows.filter("tied").groupBy("token", "p").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("p", F.struct("k", "p")).alias("usual"), F.count("*").alias("pivots")).filter("pivots > 1").select("token", "usual")
    tied = rows.filter("tied").join(usual, "token")
    apart = side(tied.filter("p <> usual"), "a").join(side(tied, "b").join(usual, "token"), "token").filter(f"{near} and p_a <> p_b and (p_b = usual or a < b)").drop("usual")
    met = free.unionByName(apart).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = met.agg(F.count("*").alias("common"), F.min(F.expr(asked)).alias("asked")).filter("common >= asked").select("a", "b")
    # one pivot: sizes within which the pivot's tokens alone could suffice
    whole = 10 + tenths
    member = main.select("sig", "p", "inter").join(size, "sig").join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    most = F.expr(f"least({whole} * inter div {tenths} - n, n * 10 div {tenths})").cast("long")
    least = F.ceil(F.col("n") * tenths / 10).cast("long")
    ranged = member.withColumn("least", least).withColumn("most", most).filter("least <= most")
    wanted = ranged.select(F.col("sig").alias("a"), "p", F.col("component").alias("c_a"), F.col("n").alias("n_a"), F.col("inter").alias("i_a"), F.explode(F.sequence("least", "most")).alias("n"))
    center = parts.select(F.col("node").alias("p"), F.col("component").alias("center"))
    wanted = wanted.join(center, "p", "left").filter("center is null or c_a <> center")  # of linked classes none meet
    others = member.select(F.col("sig").alias("b"), "p", F.col("component").alias("c_b"), "n", F.col("inter").alias("i_b"))
    sized = wanted.join(others, ["p", "n"]).filter(f"c_a <> c_b and {tenths} * (n_a + n) <= {whole} * i_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(sized).distinct().join(known, ["a", "b"], "left_anti")


def join_components(docs: DataFrame, width: int = 5, tenths: int = 8) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component_key of every row.

    Sets with at least tenths / 10 of their union in common are linked. component_key tells components apart even where
    doc_ids are null; it is null for empty sets.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = columns_or_null(docs, doc_id="long", text="string")
    sent = docs.sparkSession.sparkContext.broadcast(sketch_of(scratch, rows, width))
    sketched = _sketched(scratch, rows, sent, width, tenths, HOT)
    narrow = scratch.table(sketched.select("doc_id", "text_key", "n", "sig"))
    classes = scratch.table(sketched.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("matches").alias("matches")))
    lists = token_lists(scratch, sketched)
    scratch.drop(sketched)
    size = classes.select("sig", "n", "matches")
    of = lambda side: size.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}"), F.col("matches").alias(f"m_{side}"))
    near_size = f"10 * least(n_a, n_b) >= {tenths} * greatest(n_a, n_b)"

    # 1. stars. Pairs with few tokens in common wait for step 2, which leaves nothing out, unless very many share their pivot.
    star = scratch.table(lists.filter("sig <> pivot").groupBy(F.col("pivot").alias("a"), F.col("sig").alias("b")).agg(F.count("*").alias("common")))
    hot = star.groupBy("a").agg(F.count("*").alias("partners")).filter(f"partners > {MANY}").select("a", F.lit(True).alias("hot"))
    star = star.join(of("a"), "a").join(of("b"), "b").join(hot, "a", "left")
    promising = f"{near_size} and common >= least(m_a, m_b) and 4 * common >= least(n_a, n_b) * {10 - tenths} / 10"
    stars = compared(scratch, scratch.table(star.filter(f"hot or {promising}").select("a", "b")), classes, rows, sent, width, tenths)
    links = stars.filter("linked").select("a", "b")
    parts = connected_components(scratch, links)

    # 2. whatever could still join two components
    pairs = scratch.table(open_pairs(scratch, lists, size, stars, parts, tenths))
    more = compared(scratch, pairs, classes, rows, sent, width, tenths).filter("linked").select("a", "b")
    parts = connected_components(scratch, links.union(more))

    named = classes.select("sig", F.col("doc_id").alias("least")).join(parts.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = scratch.table(named.join(least, "component").select("sig", "component_id", F.col("component").alias("component_key")))
    scratch.keep_only(narrow, by_class)
    full, empty = narrow.filter("n > 0").join(by_class, "sig"), narrow.filter("n = 0").select("*", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_key"))
    return full.unionByName(empty).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "component_key")
