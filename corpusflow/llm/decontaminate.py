"""Operator 7: benchmark decontamination. A BM25 inverted index of the test items is queried with every passage of every text.

Items are put into classes by length; passages are overlapping windows of a class's words, so that any run of words as long as
an item lies whole in one. Scores are divided by the item's score for itself, so one threshold holds for all items.

Block-max WAND: the items of a class lie in blocks of ``BLOCK_ITEMS``, items that share words near each other, and each term knows
its largest impact in each block that holds it. A passage that can't reach the threshold in any of ``GROUPS`` ranges of blocks
goes at once, whole batches of passages in one step. For the others the terms' block lists are walked by pivot: the first block
at which the terms that have got so far could reach the threshold together; lists behind it skip to it, and its items are
scored exactly only if the maxima in that very block suffice. All items above the threshold are retrieved, and kept if the
passage holds enough of the question's and of the answer's words (weighted by idf).

The index is broadcast while the items' text stays within ``max_index_bytes``; a larger test set is worked off in slices of
items, one after another, each with an index of its own. Item count, document frequencies, average length and each class's
longest item are those of all items, so results don't depend on the number of slices. Documents are never shuffled.

Defined results: null and empty texts hold no passage. Items without words match nothing. Equal items are reported each.
Items with a null item_id are searched for like all others and reported with a null item_id, one row each.
An item that has one word only is its own question and answer. Repeated document rows are reported each. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, columns_of, columns_or_null, extended, mix, pieces, punctuation_bytes, to_driver, trimmed, words

K1, B = 1.5, 0.75
#: Items in a block, and ranges of blocks for the first bound.
BLOCK_ITEMS, GROUPS = 16, 16
#: Classes of items: up to so many words, and four times as many for each further class.
SHORTEST_CLASS = 64


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [first, last), one after another."""
    n = last - first
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)


@dataclass
class LengthClass:
    """The index of the items of one length class. A cell is a term in a block; cells lie by (term, block)."""

    stride: int
    items: np.ndarray
    #: Of each term and group of blocks: the first cell (one more entry), and the largest impact.
    first_cell: np.ndarray
    group_max: np.ndarray
    #: Of each cell: block, largest impact, first posting (one more entry).
    block: np.ndarray
    cell_max: np.ndarray
    first_posting: np.ndarray
    posting_items: np.ndarray
    impacts: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]

    def candidates(self, seen: np.ndarray, groups: np.ndarray, least: float) -> np.ndarray:
        """The cells, for distinct terms, of all blocks whose maxima reach ``least``, in groups whose maxima do."""
        if (len(self.items) - 1) // BLOCK_ITEMS < GROUPS:  # a group is a block
            key = (seen[:, None] * GROUPS + groups[None, :]).ravel()
            return ranges(self.first_cell[key], self.first_cell[key + 1])
        return np.sort(np.concatenate([self._walk(seen, int(g), least) for g in groups]))

    def scores(self, cells: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Items of the class with at least that score from these cells, and the scores."""
        at = ranges(self.first_posting[cells], self.first_posting[cells + 1])
        if len(self.items) <= 1 << 14:
            total = np.bincount(self.posting_items[at], self.impacts[at], len(self.items))
            found = np.flatnonzero(total >= least)
            return found, total[found]
        held, of = np.unique(self.posting_items[at], return_inverse=True)
        total = np.bincount(of, self.impacts[at])
        return held[total >= least], total[total >= least]

    def _walk(self, seen: np.ndarray, group: int, least: float) -> np.ndarray:
        at, end, upper = self.first_cell[seen * GROUPS + group], self.first_cell[seen * GROUPS + group + 1], self.group_max[seen, group]
        live = at < end
        at, end, upper = at[live], end[live], upper[live]
        out = []
        while True:
            block = self.block[at]
            order = np.argsort(block, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(upper[order]), least))
            if pivot >= len(order):
                return np.concatenate(out) if out else np.zeros(0, np.int64)
            here = block[order[pivot]]
            behind = np.flatnonzero(block < here)
            if len(behind):
                at[behind] = [a + np.searchsorted(self.block[a:e], here) for a, e in zip(at[behind], end[behind], strict=True)]
            met = np.flatnonzero((at < end) & (self.block[np.minimum(at, len(self.block) - 1)] == here))
            if self.cell_max[at[met]].sum() >= least:
                out.append(at[met])
            at[met] += 1
            live = at < end
            at, end, upper = at[live], end[live], upper[live]


@dataclass
class Index:
    vocabulary: np.ndarray
    idf: np.ndarray
    ids: list[int | None]
    classes: list[LengthClass]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers; unknown words have the number after the last."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(hashes), np.int64)


@dataclass
class Statistics:
    """Of all items, where an index has a slice of them. ``df`` belongs to ``vocabulary``, the slice's word hashes in order."""

    n_items: int
    average: float
    longest: dict[int, int]
    vocabulary: np.ndarray
    df: np.ndarray


def class_of(n_words: int) -> int:
    rank = 0
    while n_words > SHORTEST_CLASS * 4**rank:
        rank += 1
    return rank


def build_index(ids: list[int | None], texts: list[str | None], whole: Statistics | None = None) -> Index:
    """Without ``whole`` these are all items."""
    cut = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
    h, first = words(np.frombuffer(b"".join(cut), np.uint8), offsets, punctuation_bytes())
    vocabulary, term = np.unique(h, return_inverse=True)
    n_items, n_terms = len(ids), len(vocabulary)
    item = np.repeat(np.arange(n_items), np.diff(first))
    pairs, tf = np.unique(item * max(1, n_terms) + term, return_counts=True)
    of, term_of = pairs // max(1, n_terms), pairs % max(1, n_terms)
    length = np.diff(first)
    rank = np.array([class_of(int(n)) for n in length], np.int64)
    if whole is None:
        df = np.bincount(term_of, minlength=n_terms)
        average = length[length > 0].mean() if (length > 0).any() else 1.0
        whole = Statistics(n_items, average, {int(c): int(length[rank == c].max()) for c in np.unique(rank)}, vocabulary, df)
    df = whole.df[np.searchsorted(whole.vocabulary, vocabulary)]
    idf = np.log1p((whole.n_items - df + 0.5) / (df + 0.5))
    average = max(1.0, whole.average)
    raw = idf[term_of] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[of] / average))
    own = np.bincount(of, raw, n_items)
    impact = raw / np.maximum(own[of], 1e-12)
    classes = []
    sorted_words = [np.sort(mix(vocabulary[np.unique(term[i:j])])) for i, j in zip(first[:-1], first[1:], strict=True)]
    for c in np.unique(rank[length > 0]):
        items = np.flatnonzero((rank == c) & (length > 0))
        # by the least hashes of their words, so that items with common words are near each other
        items = items[np.lexsort(tuple(np.array([x[min(j, len(x) - 1)] for x in (sorted_words[i] for i in items)]) for j in (1, 0)))]
        place = np.full(n_items, -1)
        place[items] = np.arange(len(items))
        mine = place[of] >= 0
        where = place[of][mine]
        cell_key = term_of[mine] * (1 + len(items) // BLOCK_ITEMS) + where // BLOCK_ITEMS
        order = np.lexsort((where, cell_key))
        where, cell_key, term_here, strength = where[order], cell_key[order], term_of[mine][order], impact[mine][order]
        # a little more than the largest impact, so that rounding never hides an item
        upper = (strength * 1.0001).astype(np.float32)
        first_posting = np.flatnonzero(np.concatenate([[True], cell_key[1:] != cell_key[:-1]]))
        cell_max, block, cell_term = np.maximum.reduceat(upper, first_posting), where[first_posting] // BLOCK_ITEMS, term_here[first_posting]
        group, group_max = block * GROUPS // (1 + (len(items) - 1) // BLOCK_ITEMS), np.zeros((n_terms + 1, GROUPS), np.float32)
        np.maximum.at(group_max, (cell_term, group), cell_max)
        parts = []
        for i in items:
            t, text = term[first[i] : first[i + 1]], texts[i] or ""
            asked = text.find("?")
            if 0 <= asked < len(text) - 1:  # a question and what follows it
                head = text[: asked + 1].encode()
                n = int(words(np.frombuffer(head, np.uint8), np.array([0, len(head)]), punctuation_bytes())[1][-1])
            else:
                n = (len(t) + 1) // 2
            parts.append((np.unique(t[:n]), np.unique(t[n:] if n < len(t) else t[:n])))
        classes.append(LengthClass(whole.longest[int(c)], items, np.searchsorted(cell_term * GROUPS + group, np.arange((n_terms + 1) * GROUPS + 1)), group_max, block, cell_max, np.append(first_posting, len(where)), where, strength, parts))
    return Index(vocabulary, idf, ids, classes)


def search(index: Index, data: np.ndarray, offsets: np.ndarray, least_score: float, least_overlap: float) -> list[tuple[int, int | None, float, float, float, int]]:
    """(row, item id, best score, question overlap, answer overlap, passages) of the rows in a piece."""
    h, first = words(data, offsets, punctuation_bytes())
    if not len(h) or not index.classes:
        return []
    term = index.terms(h)
    known = np.flatnonzero(term < len(index.vocabulary))
    term_known = term[known]
    found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for c in index.classes:
        n_words = np.diff(first)
        per_row = np.maximum(1, -(-(n_words - c.stride) // c.stride)) * (n_words > 0)
        row = np.repeat(np.arange(len(n_words)), per_row)
        start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)) * c.stride
        end = np.minimum(start + 2 * c.stride, first[row + 1])
        lo, hi = np.searchsorted(known, start), np.searchsorted(known, end)  # words that no item has are left out
        able = np.zeros(len(row), bool)
        for g in range(GROUPS):
            total = np.concatenate([[0.0], np.cumsum(c.group_max[term_known, g], dtype=np.float64)])
            able |= total[hi] - total[lo] >= least_score
        for w in np.flatnonzero(able):
            seen = np.unique(term_known[lo[w] : hi[w]])
            # repeated words count once; most passages that passed above fail here
            groups = np.flatnonzero(c.group_max[seen].sum(0, dtype=np.float64) >= least_score)
            if not len(groups):
                continue
            for i, score in zip(*c.scores(c.candidates(seen, groups, least_score), least_score), strict=True):
                shares = [index.idf[p[np.isin(p, seen, assume_unique=True)]].sum() / max(1e-12, index.idf[p].sum()) for p in c.parts[i]]
                if min(shares) < least_overlap:
                    continue
                key = (int(row[w]), int(c.items[i]))
                best = found.get(key, (0.0, 0.0, 0.0, 0))
                found[key] = (*max(best[:3], (float(score), *map(float, shares))), best[3] + 1)
    return [(r, index.ids[i], *v) for (r, i), v in found.items()]


def word_lists(items: DataFrame) -> DataFrame:
    """slice, class, number of words and distinct word hashes of every item; items have text and slice."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                h, first = words(data, offsets, punctuation_bytes())
                n = np.diff(first)
                sets = [np.unique(h[i:j]).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)]
                columns = [b.column(1).slice(lo, hi - lo), pa.array([class_of(int(x)) for x in n], pa.int32()), pa.array(n, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "class", "n", "hashes"])

    return items.select("text", "slice").mapInArrow(trimmed(measure), "slice int, class int, n long, hashes array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.5, least_overlap: float = 0.7, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", max_index_bytes: int = 32 << 20) -> DataFrame:
    """A row for each document and item found in it: ids, item_id, score, question_overlap, answer_overlap, passages."""
    sc = docs.sparkSession.sparkContext
    items = columns_or_null(benchmark, item_id="long", text="string")
    size = items.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    slices = max(1, -(-size // max_index_bytes))
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int"))
    if slices > 1:
        scratch = Scratch(docs.sparkSession, "decontaminate")
        measured = scratch.table(word_lists(items))
        by_class = measured.groupBy("class").agg(F.count("*"), F.sum("n"), F.count(F.when(F.col("n") > 0, 1)), F.max("n")).collect()
        n_items, n_words, n_worded = (sum(r[i] for r in by_class) for i in (1, 2, 3))
        # a word has a row in each slice that holds it, with the number of items in all slices
        held = measured.select("slice", F.explode("hashes").alias("hash")).groupBy("hash", "slice").agg(F.count("*").alias("df"))
        frequencies = scratch.table(held.withColumn("df", F.sum("df").over(W.partitionBy("hash"))))

    def statistics(part: int) -> Statistics | None:
        if slices == 1:
            return None
        got = to_driver(frequencies.filter(F.col("slice") == part).select("hash", "df"))
        vocabulary, df = got["hash"].to_numpy().view(np.uint64), got["df"].to_numpy()
        order = np.argsort(vocabulary)
        return Statistics(n_items, n_words / max(1, n_worded), {r["class"]: r[4] for r in by_class}, vocabulary[order], df[order])

    docs = columns_of(docs, *dict.fromkeys((*id_columns, text_column)))
    rows = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(id_columns)))
    schema = extended(docs.select(*(F.col(f"`{c}`") for c in id_columns)).schema, item_id="long", score="double", question_overlap="double", answer_overlap="double", passages="int")
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]

    def one(part: int) -> DataFrame:
        got = to_driver(items.filter(F.col("slice") == part)).sort_by("item_id")
        sent = sc.broadcast(build_index(got["item_id"].to_pylist(), got["text"].to_pylist(), statistics(part)))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, _, data, offsets in pieces(b):
                    hits = search(sent.value, data, offsets, least_score, least_overlap)
                    if hits:
                        at = pa.array([lo + x[0] for x in hits])
                        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[1:]), *(pa.array([x[j + 1] for x in hits], k) for j, k in enumerate(kinds))], names=schema.fieldNames())

        return rows.mapInArrow(trimmed(probe), schema)

    return reduce(DataFrame.unionByName, [one(i) for i in range(slices)])
