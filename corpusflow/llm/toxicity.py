"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours and pairs with one word between, hashed to ``2 ** bits`` places; each counts
once. Learning goes over a bounded sample of labelled rows (``train_docs`` rows, ``train_bytes`` bytes), a few times, with a rate
of its own for each place and an L1 pull, so that most weights are exactly zero. The weights have a fixed size (a ``2 ** bits`` float vector) and are
broadcast; scoring is one narrow pass over whole texts.

Defined results: null and empty texts have no features and get the intercept's score. Without labelled rows the score is 0.5.
Repeated rows get equal scores and count once in learning; an empty table gives no rows. Extra columns are ignored, and rows with
a null doc_id or label don't teach. A document with two labels counts once for each. Very long texts are scored whole; they teach
only if ``train_bytes`` can hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns_of, columns_or_null, extended, mix, pieces, punctuation_bytes, to_driver, trimmed, words

#: Multipliers that keep words, neighbours and skip-grams apart (fixed odd numbers).
PAIR_LEFT, PAIR_RIGHT, SKIP_LEFT, SKIP_RIGHT = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature in the piece, repeats included."""
    h, first = words(data, offsets, punctuation_bytes())
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, codes = [row], [h]
    for gap, left, right in ((1, PAIR_LEFT, PAIR_RIGHT), (2, SKIP_LEFT, SKIP_RIGHT)):
        same = np.flatnonzero(row[gap:] == row[:-gap])
        rows.append(row[same])
        codes.append(mix(h[same] * left + h[same + gap] * right))
    return np.concatenate(rows), (np.concatenate(codes) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Ftrl:
    """Weights come from z and n only when they are needed: zero while |z| is within l1."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4) -> tuple[np.ndarray, float]:
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        z0 = n0 = bias = 0.0
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at = rows[i]
                zi, ni = z[at], n[at]
                w = np.where(np.abs(zi) <= self.l1, 0.0, (np.sign(zi) * self.l1 - zi) / ((self.beta + np.sqrt(ni)) / self.alpha + self.l2))
                p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
                g = p - labels[i]
                z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha * w
                n[at] += g * g
                z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / self.alpha * bias
                n0 += g * g
                bias = -z0 / ((self.beta + np.sqrt(n0)) / self.alpha)
        w = np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return w.astype(np.float32), float(bias)


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin that parts the labels best (greatest F1), halfway between two rows; 0 with under ten rows of a label."""
    if min(labels.sum(), (1 - labels).sum()) < 10:
        return 0.0
    order = np.argsort(-margins, kind="stable")
    m, hits = margins[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(m) + 1) + labels.sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    at = int(np.argmax(f1))
    return float((m[at] + (m[at + 1] if at + 1 < len(m) else m[at] - 1)) / 2)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 12_000, train_bytes: int = 48 << 20, learner: Ftrl | None = None) -> tuple[np.ndarray, float]:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). The intercept is set so that a score of 0.5 is the cut that parts
    one training row in five best, after learning from the other four."""
    learner = learner or Ftrl()
    bits = learner.bits

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                row, place = features(data, offsets, bits)
                both = np.unique((row << bits) | place)
                row, place = both >> bits, (both & ((1 << bits) - 1)).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column(1)[lo:hi], b.column(2)[lo:hi], pa.array([place[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["label", "key", "places"])

    rows = bounded_sample(docs, labels, train_docs, train_bytes)
    got = to_driver(rows.select("text", F.col("label").cast("int"), "key").mapInArrow(trimmed(encode), "label int, key long, places binary")).sort_by([("key", "ascending"), ("label", "ascending")])
    if not got.num_rows:
        return np.zeros(1 << bits, np.float32), 0.0
    places, label = [np.frombuffer(x, np.int32) for x in got["places"].to_pylist()], got["label"].to_numpy().astype(np.float64)
    held = np.arange(len(places)) % 5 == 0  # rows lie in the order of a hash
    w, bias = learner.fit([x for x, h in zip(places, held, strict=True) if not h], label[~held])
    cut = best_cut(np.array([w[x].sum() + bias for x, h in zip(places, held, strict=True) if h]), label[held])
    w, bias = learner.fit(places, label)
    return w, bias - cut


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The id columns and the score (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    bits = int(len(weights)).bit_length() - 1
    docs = columns_of(docs, *dict.fromkeys((*id_columns, text_column)))
    rows = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(id_columns)))
    schema = extended(docs.select(*(F.col(f"`{c}`") for c in id_columns)).schema, score="double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = sent.value
        for b in batches:
            for lo, hi, data, offsets in pieces(b):
                row, place = features(data, offsets, bits)
                known = w[place] != 0
                both = np.unique((row[known] << bits) | place[known])
                s = np.bincount(both >> bits, w[both & ((1 << bits) - 1)], hi - lo) + b0
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[1:]), pa.array(1.0 / (1.0 + np.exp(-np.clip(s, -35, 35))))], names=schema.fieldNames())

    return rows.mapInArrow(trimmed(judge), schema)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, is_training, **options) -> DataFrame:
    """Fit on labelled documents where ``is_training`` holds (over doc_id), and score all: doc_id, score."""
    rows = columns_or_null(docs, doc_id="long", text="string")
    marks = columns_or_null(labels, doc_id="long", toxic="int").filter("toxic in (0, 1)").filter(is_training)
    weights, bias = train(rows, marks.withColumnRenamed("toxic", "label"), **options)
    return score(rows, weights, bias)
