"""Operator 7: benchmarks that are cut into slices."""

import random

import numpy as np

from corpusflow.llm import decontaminate


def edited_leaks(seed):
    """Items that share many words, and documents with copies of them in which up to half of the words are others."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(150)] + ["the", "of", "and"] * 20
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 60, 90, 200])))) for i in range(40)] + [(90, None), (91, "!!")]
    docs = []
    for i in range(150):
        w, t = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))], items[rng.randrange(40)][1].split()
        for _ in range(rng.randrange(0, 1 + len(t) // 2)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + t + w[at:])))
    return docs, items


def test_slices_do_not_change_the_result(spark):
    docs, items = edited_leaks(1)
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontaminate.find_leaks(docs, items).collect())
    assert any(r[2] < 0.75 for r in whole) and any(min(r[3:5]) < 0.75 for r in whole)
    for most in (4000, 1000):
        assert sorted(tuple(r) for r in decontaminate.find_leaks(docs, items, max_index_bytes=most).collect()) == whole


def test_items_without_id(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(4)]
    items = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (None, texts[2]), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)], "doc_id long, text string")
    for most in (1 << 20, 150):
        got = decontaminate.find_leaks(docs, items, max_index_bytes=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, None), (2, None)} and len(got) == 3


def test_walk_by_pivots_loses_nothing(monkeypatch):
    """Small blocks in few groups against one block that holds all items, over more than one piece of text."""
    docs, items = edited_leaks(2)
    items = [(1000 * k + i, t) for k in range(3) for i, t in items if t]  # equal items are reported each
    texts = [t for _, t in docs] + ["", " ".join(t for _, t in docs) * 3]
    cut = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(cut), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in cut])])
    found = []
    for block, groups in ((1 << 20, 1), (16, 16), (4, 3), (1, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        monkeypatch.setattr(decontaminate, "GROUPS", groups)
        index = decontaminate.build_index(*map(list, zip(*items)))
        hits = decontaminate.search(index, data, offsets, 0.5, 0.7)
        found.append(sorted((r, i, *(round(x, 9) for x in v[:3]), v[3]) for r, i, *v in hits))
    assert found[0] and all(f == found[0] for f in found) and len(found[0]) % 3 == 0
