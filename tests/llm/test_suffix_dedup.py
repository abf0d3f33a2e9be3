"""Removed bytes against brute force: planted repeats, periodic text, split groups, nulls and repeated rows."""

import hashlib
import random

import numpy as np
import pytest

from corpusflow.llm import queries
from corpusflow.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for (d, _), b in zip(rows, texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), len(S.runs_of(gone)), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, hash int, spans string")
    out = S.remove_repeats(df, **options)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.drop("kept").collect()), key=repr)


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    passage = ["".join(word() for _ in range(rng.randrange(4, 30))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [word() for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passage)[rng.randrange(5) :])
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, group, many", [(1, 2000, 10_000), (2, 3, 4)])
def test_against_brute_force(spark, monkeypatch, seed, group, many):
    monkeypatch.setattr(S, "MANY", many)
    rng = random.Random(seed)
    rows = corpus(rng, 150)
    rows += [(200, "ab" * 60), (201, "x" * 30), (202, None), (203, ""), (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (204, "ngắn"), (205, "\0" * 50)]
    assert run(spark, rows, length=20, gram=6, group=group) == brute(rows, 20)


def test_production_length(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(900)
    rows = [(i, text(rng.randrange(300)) + shared[rng.randrange(40) : 900 - rng.randrange(40)] + text(rng.randrange(300))) for i in range(40)]
    rows += [(90, text(399)), (91, shared[:399]), (92, text(3000)), (93, text(200_000))]
    assert run(spark, rows) == brute(rows, 400)


def test_text_that_is_left(spark, tmp_path):
    """The query's text is what is left; a cut character is marked."""
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefé ") for _ in range(500))
    rows = [(1, "xyz" + shared + "é!"), (2, "q" + shared + "è"), (3, None), (4, "whole")]  # é and è begin with the same byte
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got[3].text == "" and got[4].text == "whole" and got[2].text == "q\ufffd" and got[1].text == "xyz\ufffd!"
    assert got[1].kept_sha256 == hashlib.sha256(b"xyz\xa9!").hexdigest()


def test_blocks_alone():
    rng = random.Random(9)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))).encode() for _ in range(5)]
        seen = {}
        for t in texts:
            for k in range(len(t) - 7):
                seen[t[k : k + 8]] = seen.get(t[k : k + 8], 0) + 1
        want = [[seen[t[k : k + 8]] > 1 for k in range(len(t) - 7)] for t in texts]
        assert [x.tolist() for x in S.repeated_windows(texts, 8)] == want


def test_empty_table(spark):
    assert run(spark, []) == []
