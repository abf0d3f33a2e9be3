"""Operator 2: quality classifier by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s): one score s = w . x is shared by all grades, and the thresholds are ordered. x holds
the shares of a text's byte trigrams and of its words' shapes (case, length, ending, whether the word before is the same), hashed
to ``2 ** bits`` places. The fit goes over a bounded sample of graded rows (``train_docs`` rows, ``train_bytes`` bytes); weights and
thresholds have a fixed size and are broadcast; all rows are scored in one narrow pass over whole texts.
Results: the expected grade, and the tail probability P(grade >= tail) by which documents are selected.

Defined results: null texts and texts under three bytes have no trigrams; their s is 0, so they get the thresholds' own
probabilities. Without graded rows all grades are alike. Rows with a null doc_id or grade don't teach. Repeated rows get equal
results and teach once; an empty table gives no rows. Extra columns are ignored. Very long texts are graded whole; they teach only
if ``train_bytes`` can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns_of, columns_or_null, extended, mix, pieces, row_sums, space_bytes, to_driver, trimmed, word_bounds, words

#: Shares are small numbers; this factor makes the steps of the fit about equal in all directions.
SCALE = 30.0
#: Shares of word shapes are larger; this factor brings them to the size of the trigrams' shares.
SHAPE = 0.1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the byte trigrams inside rows, and the number of each row's first (one more entry than rows)."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    x = data.astype(np.uint64)
    place = (mix(x[:-2] | (x[1:-1] << np.uint64(8)) | (x[2:] << np.uint64(16))) >> np.uint64(64 - bits)).astype(np.int64)
    crosses = np.zeros(len(place), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        crosses[at[(at >= 0) & (at < len(place))]] = True
    kept = np.flatnonzero(~crosses)
    return place[kept], np.searchsorted(kept, offsets)


def shapes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the shapes of all words, and the number of each row's first (one more entry than rows)."""
    h, first = words(data, offsets, space_bytes())
    if not len(h):
        return np.zeros(0, np.int64), first
    s, e = word_bounds(data, offsets, space_bytes())
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    starts = first[:-1]
    same[starts[starts < len(h)]] = False
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    ends = np.where(letter[e - 1], 0, data[e - 1].astype(np.int64))
    code = ((np.minimum(e - s, 15) // 3 * 2 + same) * 2 + upper[s]) * 2 + upper[np.minimum(s + 1, e - 1)]
    both = (code * 2 + letter[np.maximum(e - 2, s)]) * 256 + ends
    return (mix(both.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - bits)).astype(np.int64), first


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(places, each row's first, factor of the shares) of both kinds."""
    return [(*trigrams(data, offsets, bits), 1.0), (*shapes(data, offsets, bits), SHAPE)]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k; columns fall from left to right."""
        return sigmoid(s[:, None] - self.thresholds[None, :])


def likelihood(s: np.ndarray, grades: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log likelihood of the grades, its slope by each row's s, and by each threshold."""
    cdf = np.concatenate([np.zeros((len(s), 1)), sigmoid(theta[None, :] - s[:, None]), np.ones((len(s), 1))], 1)
    slope = cdf * (1 - cdf)
    at = np.arange(len(s))
    p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-9)
    up, down = slope[at, grades + 1] / p, slope[at, grades] / p
    by_theta = np.array([up[grades == k].sum() - down[grades == k + 1].sum() for k in range(len(theta))]) / len(s)
    return float(np.log(p).mean()), (down - up) / len(s), by_theta


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, bits: int, steps: int = 250, rate: float = 0.3, l2: float = 1e-4) -> OrdinalModel:
    """rows: (places, shares) of each text. Nesterov steps on the mean log likelihood; gaps between thresholds stay positive."""
    w, speed = np.zeros(1 << bits), np.zeros(1 << bits)
    share_of = np.array([(grades <= k).mean() if len(grades) else (k + 1) / n_grades for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.log(share_of / (1 - share_of))
    theta = np.maximum.accumulate(theta + np.arange(n_grades - 1) * 1e-3)
    if not rows:
        return OrdinalModel(w.astype(np.float32), theta, bits)
    first = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])])
    place, x = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]) * SCALE
    of = np.repeat(np.arange(len(rows)), np.diff(first))
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))
    base = theta[0]
    for _ in range(steps):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        ahead = w + 0.9 * speed
        _, by_s, by_theta = likelihood(row_sums(ahead[place] * x, first), grades, theta)
        speed = 0.9 * speed + rate * (np.bincount(place, by_s[of] * x, 1 << bits) - l2 * ahead)
        w = w + speed
        later = np.cumsum(by_theta[::-1])[::-1]
        base += rate * later[0]
        gaps = np.clip(gaps + rate * later[1:] * np.exp(gaps), -7, 3)
    theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return OrdinalModel((w * SCALE).astype(np.float32), theta, bits)


def train(docs: DataFrame, graded: DataFrame, n_grades: int, train_docs: int = 6_000, train_bytes: int = 32 << 20, bits: int = 16) -> OrdinalModel:
    """docs: doc_id, text; graded: doc_id, label (0 .. n_grades - 1)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                kinds, out = features(data, offsets, bits), []
                for i in range(hi - lo):
                    places, shares = [], []
                    for place, first, factor in kinds:
                        own, n = np.unique(place[first[i] : first[i + 1]], return_counts=True)
                        places.append(own)
                        shares.append(factor * n / max(1, first[i + 1] - first[i]))
                    out.append((np.concatenate(places).astype(np.int32).tobytes(), np.concatenate(shares).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["grade", "key", "places", "shares"])

    rows = bounded_sample(docs, graded.filter(F.col("label").between(0, n_grades - 1)), train_docs, train_bytes).select("text", F.col("label").cast("int"), "key")
    got = to_driver(rows.mapInArrow(trimmed(encode), "grade int, key long, places binary, shares binary")).sort_by([("key", "ascending"), ("grade", "ascending")])
    texts = [(np.frombuffer(p, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for p, v in zip(got["places"].to_pylist(), got["shares"].to_pylist(), strict=True)]
    return fit(texts, got["grade"].to_numpy().astype(np.int64), n_grades, bits)


def grade(docs: DataFrame, model: OrdinalModel, tail: int, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The id columns, expected_grade and tail_prob = P(grade >= tail) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = columns_of(docs, *dict.fromkeys((*id_columns, text_column)))
    rows = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(id_columns)))
    schema = extended(docs.select(*(F.col(f"`{c}`") for c in id_columns)).schema, expected_grade="double", tail_prob="double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                s = np.zeros(hi - lo)
                for place, first, factor in features(data, offsets, m.bits):
                    s += factor * row_sums(m.weights[place], first) / np.maximum(1, np.diff(first))
                tails = m.tails(s)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[1:]), pa.array(tails.sum(1)), pa.array(np.ascontiguousarray(tails[:, tail - 1]))], names=schema.fieldNames())

    return rows.mapInArrow(trimmed(judge), schema)


def select_by_quality(docs: DataFrame, ratings: DataFrame, is_training, n_grades: int, tail: int, least: float = 0.5, **options) -> DataFrame:
    """ratings: doc_id, grade. Fit where ``is_training`` holds; all rows: doc_id, expected_grade, tail_prob, selected."""
    rows = columns_or_null(docs, doc_id="long", text="string")
    graded = columns_or_null(ratings, doc_id="long", grade="int").filter(is_training).withColumnRenamed("grade", "label")
    model = train(rows, graded, n_grades, **options)
    return grade(rows, model, tail).withColumn("selected", F.col("tail_prob") >= least)
