"""Models are pluggable; these are the deterministic defaults that need no weights and no network."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import config
from .functions import text as X


class Summariser(Protocol):
    def __call__(self, chunks: DataFrame) -> DataFrame:
        """chunk_id, chunk_text -> chunk_id, short, key."""


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column:
        """A vector (array<double>) of fixed length."""


class Generator(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """qid, system, prompt -> qid, answer. Decoding must be greedy: equal prompts give equal answers."""


class Reranker(Protocol):
    def __call__(self, question: Column, text: Column) -> Column:
        """A relevance in [0, 1]."""


def first_sentence_summary(chunks: DataFrame, most_points: int = 5, most_chars: int = 3000) -> DataFrame:
    """The first sentence as ``short``, the first clauses as ``key``; blank texts give '' and []."""
    text = F.substring(F.coalesce("chunk_text", F.lit("")), 1, most_chars)
    return chunks.select("chunk_id", F.coalesce(F.try_element_at(X.sentences(text), F.lit(1)), F.lit("")).alias("short"), F.slice(X.clauses(text), 1, most_points).alias("key"))


#: Places of ``word_counts``: a word's place is its MD5's first hexadecimal digits.
WORD_PLACES = 256


def word_counts(text: Column) -> Column:
    """How often words of each hash occur: a stand-in for an embedding model, the same in every language that knows MD5."""

    @F.pandas_udf("array<double>")
    def count(texts: pd.Series) -> pd.Series:
        split = pc.split_pattern(pc.fill_null(pa.array(texts, pa.string()), ""), " ")
        words = pc.list_flatten(split).dictionary_encode()
        # a batch's different words are hashed once; an empty text is one empty word, which counts nothing
        digits = np.array([int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:2], 16) if w else -1 for w in words.dictionary.to_pylist()], dtype=np.int64)
        row, place = pc.list_parent_indices(split).to_numpy(), digits[words.indices.to_numpy()] if len(digits) else np.zeros(0, np.int64)
        cells = np.bincount((row * WORD_PLACES + place)[place >= 0], minlength=len(texts) * WORD_PLACES)
        return pd.Series(list(cells.reshape(-1, WORD_PLACES).astype(float)), index=texts.index)

    return count(F.array_join(X.tokens(F.lower(F.coalesce(text, F.lit("")))), " "))


def first_context_answer(prompts: DataFrame) -> DataFrame:
    """A generator without a model: the first context of the prompt with its heading, and the disclaimer."""
    context = F.regexp_extract("prompt", r"(?s)\n\[1\] (.*?)(?:\n\n\[2\] |\n\n" + config.RELATIONS_HEADING.replace("(", r"\(").replace(")", r"\)") + ")", 1)
    return prompts.select("qid", F.concat(F.lit("1) "), context, F.lit("\n4) " + config.DISCLAIMER)).alias("answer"))


def pandas_generator(generate):
    """Wraps ``generate(system prompts, user prompts) -> answers`` (a model loaded once per worker) as a Generator."""

    def answer(prompts: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"qid": pdf["qid"], "answer": generate(list(pdf["system"]), list(pdf["prompt"]))})

        qid = prompts.schema["qid"].dataType.simpleString()
        return prompts.select("qid", "system", "prompt").mapInPandas(run, f"qid {qid}, answer string")

    return answer


def lexical_overlap(question: Column, text: Column) -> Column:
    """The share of the question's distinct lower-case tokens that the text has."""
    asked, held = F.array_distinct(X.tokens(F.lower(question))), F.array_distinct(X.tokens(F.lower(text)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, held)).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def pandas_summariser(generate, max_input_chars: int = 3000):
    """Wraps ``generate(list of prompts) -> list of replies`` (a model loaded once per worker) as a Summariser."""

    def summarise(chunks: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "reply": generate(list(pdf["prompt"]))})

        prompts = chunks.select("chunk_id", X.summary_prompt(F.col("chunk_text"), max_input_chars).alias("prompt"))
        replies = prompts.mapInPandas(run, "chunk_id string, reply string").withColumn("r", X.summary_reply(F.col("reply")))
        return replies.select("chunk_id", F.coalesce("r.short", F.lit("")).alias("short"), F.coalesce("r.key", F.array().cast("array<string>")).alias("key"))

    return summarise
