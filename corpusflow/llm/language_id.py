"""Operator 9: language identification by word-first backoff.

A word that the training texts know adds its log frequency in each language. A word that they don't know is cut into the
longest character n-grams that are known (5 letters first, then 4, 3, 2, 1, with the word's edges marked), and their mean log
frequency counts in its place.

Training: counts over a bounded sample of labelled rows (``train_docs`` rows, ``train_bytes`` bytes); the words and n-grams kept are the most frequent,
``max_entries`` of each, so the model has a fixed size bound and is broadcast. Prediction: one narrow pass over whole texts.

Defined results: a null text, or one without a letter, gives ``und`` with score 0. Without any training row, all texts give
``und``. Ties go to the language that is first by code point. Repeated rows get equal results; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns_of, columns_or_null, extended, to_driver, trimmed

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Unseen words scored by n-grams are kept for the next text, so many at most.
MEMORY = 50_000
#: Different words that a task counts before it passes them on.
WORDS_HELD = 10_000
#: Rows that go back at once.
ROWS = 1000


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Number-like signs such as a superscript two are not letters."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    word_scores: dict[str, tuple[float, ...]]
    gram_scores: dict[str, tuple[float, ...]]

    def score_word(self, word: str) -> tuple[float, ...] | None:
        known = self.word_scores.get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            found = [s for g in grams(word, n) if (s := self.gram_scores.get(g)) is not None]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        return None

    def predict(self, text: str | None, memory: dict) -> tuple[str, float]:
        found = letters(text)
        if not found or not self.languages:
            return "und", 0.0
        total = [0.0] * len(self.languages)
        for word, times in Counter(found).items():
            s = self.word_scores.get(word)
            if s is None:
                if word in memory:
                    s = memory[word]
                else:
                    s = self.score_word(word)
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[word] = s
            if s is not None:
                for i, x in enumerate(s):
                    total[i] += times * x
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        return self.languages[best], 1.0 / sum(math.exp(max(-700.0, t - total[best])) for t in total)


def _keep_frequent(counts: DataFrame, max_entries: int) -> DataFrame:
    """Entries whose total count is at least the least limit that keeps no more than max_entries of a kind."""
    top = 4096
    totals = counts.groupBy("kind", "entry").agg(F.sum("n").alias("total"))
    heights = {"w": [0] * (top + 1), "g": [0] * (top + 1)}
    for kind, height, n in totals.groupBy("kind", F.least("total", F.lit(top)).alias("height")).count().collect():  # 2 x 4096 rows at most
        heights[kind][height] = n
    least = {}
    for kind, h in heights.items():
        kept, at = 0, top
        while at > 1 and kept + h[at] <= max_entries:
            kept += h[at]
            at -= 1
        least[kind] = at + 1 if kept + h[at] > max_entries else at
    frequent = totals.filter((F.col("total") >= F.when(F.col("kind") == "w", least["w"]).otherwise(least["g"]))).select("kind", "entry")
    return counts.join(frequent, ["kind", "entry"], "left_semi")


def train(labelled: DataFrame, train_docs: int = 4_000, train_bytes: int = 64 << 20, max_entries: int = 60_000) -> Model:
    """labelled: doc_id, text, lang (rows with a null lang or text don't count)."""
    rows = bounded_sample(labelled.withColumnRenamed("lang", "label"), None, train_docs, train_bytes).withColumnRenamed("label", "lang")

    def entries(by: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, seen in by.items():
            parts: Counter = Counter()
            for word, times in seen.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        parts[g] += times
            for kind, found in (("w", seen), ("g", parts)):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array(list(found)), pa.array([lang] * len(found)), pa.array(list(found.values()), pa.int64())], names=["kind", "entry", "lang", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                by.setdefault(lang.as_py(), Counter()).update(letters(text.as_py()))
                if sum(map(len, by.values())) > WORDS_HELD:
                    yield from entries(by)
                    by = {}
        yield from entries(by)

    counts = rows.select("text", "lang").mapInArrow(trimmed(count), "kind string, entry string, lang string, n long").groupBy("kind", "entry", "lang").agg(F.sum("n").alias("n")).persist()
    try:
        # entries of one letter run are held apart by the length of the n-gram, which is the length of the entry
        sums = counts.groupBy("kind", "lang", F.when(F.col("kind") == "w", 0).otherwise(F.length("entry")).alias("length")).agg(F.sum("n").alias("n")).collect()  # languages x 6 rows
        kept = to_driver(_keep_frequent(counts, max_entries)).to_pydict()
    finally:
        counts.unpersist()
    languages = sorted({r["lang"] for r in sums})
    place = {x: i for i, x in enumerate(languages)}
    mass: dict[tuple[str, int], list[int]] = {}
    for r in sums:
        mass.setdefault((r["kind"], r["length"]), [0] * len(languages))[place[r["lang"]]] = r["n"]
    tables: dict[str, dict[str, list[int]]] = {"w": {}, "g": {}}
    for kind, entry, lang, n in zip(kept["kind"], kept["entry"], kept["lang"], kept["n"], strict=True):
        tables[kind].setdefault(entry, [0] * len(languages))[place[lang]] = n

    def logs(kind: str) -> dict[str, tuple[float, ...]]:
        out, made = {}, {}  # most entries are rare: those of one kind with equal counts share their scores
        for entry, counted in tables[kind].items():
            length = len(entry) if kind == "g" else 0
            if (same := (length, *counted)) not in made:
                made[same] = tuple(math.log((c + 0.5) / (t + 1000.0)) for c, t in zip(counted, mass[kind, length], strict=True))
            out[entry] = made[same]
        return out

    return Model(languages, logs("w"), logs("g"))


def identify(docs: DataFrame, model: Model, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The id columns, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = columns_of(docs, *dict.fromkeys((*id_columns, text_column)))
    ids = docs.select(*(F.col(f"`{c}`") for c in id_columns))
    schema = extended(ids.schema, lang_pred="string", score="double")
    at = id_columns.index(text_column) if text_column in id_columns else len(id_columns)  # a text is sent once
    rows = ids if at < len(id_columns) else docs.select(*(F.col(f"`{c}`") for c in id_columns), F.col(f"`{text_column}`").cast("string").alias("_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            found = [sent.value.predict(t.as_py(), memory) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(id_columns)], pa.array([f[0] for f in found], pa.string()), pa.array(np.array([f[1] for f in found], np.float64))], names=schema.fieldNames())

    return rows.mapInArrow(trimmed(predict), schema)


def language_of_documents(docs: DataFrame, is_training, **options) -> DataFrame:
    """Fit on the rows where ``is_training`` holds, and predict all rows: doc_id, lang_pred, score."""
    rows = columns_or_null(docs, doc_id="long", text="string", lang="string")
    return identify(rows, train(rows.filter(is_training), **options))
