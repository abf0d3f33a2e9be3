"""Balance, gapless slots and defined results; one hot source, equal rows, nulls."""

import random
import zlib
from collections import defaultdict

import pytest

from corpusflow.llm import kdtree


def check(rows, out, shards):
    want = sorted((repr(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in out) == want
    slots, sums = defaultdict(list), defaultdict(int)
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sums[i] for i in range(shards)]


@pytest.mark.parametrize("kind", ["mixed", "one source", "equal rows"])
def test_near_equal_bytes(spark, kind):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        text = "x" * rng.randrange(1, 400)
        source = rng.choice(["a", "b", None, "hot", "hot"]) if kind == "mixed" else "hot"
        rows.append((i, text, rng.choice(["en", None, "de"]), source, 7) if kind != "equal rows" else (5, "same", "en", "hot", 7))
    rows += [(None, None, None, None, None), (9000, "", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    sums = check(rows, kdtree.shard_documents(df, shards=40).collect(), 40)
    mean = sum(sums) / 40
    assert max(abs(s - mean) for s in sums) <= 0.02 * mean + 500


def test_reruns_agree_and_target_bytes(spark):
    df = spark.createDataFrame([(i, "y" * (i % 50), "en", f"s{i % 3}") for i in range(500)], "doc_id long, text string, lang string, source string")
    one = {r.doc_id: (r.shard, r.slot) for r in kdtree.shard_documents(df, target_bytes=2000).collect()}
    two = {r.doc_id: (r.shard, r.slot) for r in kdtree.shard_documents(df.repartition(7), target_bytes=2000).collect()}
    assert one == two and len({s for s, _ in one.values()}) > 5


def test_empty_and_few(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert kdtree.shard_documents(spark.createDataFrame([], schema), shards=40).count() == 0
    rows = [(1, "a", "en", "s"), (2, "z" * 50_000, "en", "s")]
    check(rows, kdtree.shard_documents(spark.createDataFrame(rows, schema), shards=40).collect(), 40)


def plain_tree(rows, leaves, whole, first=0):
    """The same law by plain recursion: {row number: leaf}. rows: (number, size, {dimension: value}, tie, uid)."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = lambda d: (max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) / max(1, whole[d])
    dimension = max(kdtree.DIMENSIONS, key=spread)
    order, quota = sorted(rows, key=lambda r: (r[2][dimension], r[3], r[4])), sum(r[1] for r in rows) * (leaves // 2) / leaves
    seen, cut = 0, 0
    while cut < len(order) and seen + order[cut][1] < quota:
        seen, cut = seen + order[cut][1], cut + 1
    if cut < len(order) and 2 * (quota - seen) >= order[cut][1]:
        cut += 1
    return plain_tree(order[:cut], leaves // 2, whole, first) | plain_tree(order[cut:], leaves - leaves // 2, whole, first + leaves // 2)


def test_like_a_plain_tree(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "TOLERANCE", 0.0)
    rng = random.Random(6)
    rows = [(i, "z" * rng.choice([3, 40, rng.randrange(300)]) + rng.choice("abcdefgh"), rng.choice(["en", "de", None]), rng.choice(["s", "t", "hot", "hot", "hot"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    meta = kdtree.metadata(df, 16).collect()
    plain = [(r.doc_id, r.size, {d: r[d] for d in kdtree.DIMENSIONS}, r.tie, r.uid) for r in meta]
    whole = {d: max(r[2][d] for r in plain) - min(r[2][d] for r in plain) for d in kdtree.DIMENSIONS}
    for leaves in (2, 7):
        got = {r.doc_id: r.shard for r in kdtree.shard_documents(df, shards=leaves).collect()}
        assert got == plain_tree(plain, leaves, whole)


def test_copies_stay_together(spark):
    """Copies with equal metadata share a shard, unless a cut falls among them."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 200))) for _ in range(300)]
    rows = [(i, rng.choice(texts[:30]) if i % 3 == 0 else texts[i % 300], "en", "s") for i in range(1200)]
    shards = defaultdict(set)
    text_of = dict((r[0], r[1]) for r in rows)
    for r in kdtree.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=10).collect():
        shards[text_of[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 9
