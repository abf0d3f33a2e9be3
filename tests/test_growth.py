"""What goes between tasks: it must grow with the input or slower, and not with queries times documents."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def shuffled(spark):
    """Rows written to shuffles since the last call."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    last = [0]

    def rows():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        total = sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))
        new, last[0] = total - last[0], total
        return new

    rows()
    return rows


def test_neither_postings_nor_hits_are_shuffled(spark, shuffled):
    from corpusflow.operators import lexical

    rng = random.Random(3)
    n, words = 3000, [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 20))) for i in range(n)], "k long, t string").repartition(4).localCheckpoint()
    q = spark.createDataFrame([(i, " ".join(rng.sample(words, 5))) for i in range(20)], "id int, q string").localCheckpoint()
    shuffled()
    got = lexical.search(lexical.build_index(docs, "k", "t"), q, "id", "q", 5).collect()
    assert len(got) == 100 and shuffled() < n  # 60,000 postings, and as many pairs of query and document


def test_expansion_meets_few_chunks_of_a_hub(spark, shuffled):
    """A concept and a document with many articles: their first chunks by chunk_id, past the seeds, in the order of their scores."""
    from corpusflow import config
    from corpusflow.operators import expand

    n, n_queries, p = 2000, 40, config.Retrieval(expanded_top=10)
    name = [f"a{i:04}" for i in range(n)]
    chunks = spark.createDataFrame([(a, a, 0) for a in name], "chunk_id string, doc_uid string, part_idx int").localCheckpoint()
    edges = [("DOC:x" if i % 2 else "DOC:y", f"ART:{a}", "HAS_ARTICLE") for i, a in enumerate(name)] + [("DOC:x", "DOC:y", "DETAILS")]
    edges = spark.createDataFrame(edges + [(f"ART:{a}", "CONCEPT:c", "MENTIONS") for a in name], "src string, dst string, rel string").localCheckpoint()
    seeds = [(q, name[i], s) for q in range(n_queries) for i, s in ((q, 0.9), (q + 1, 0.8), (n - 1 - q, 0.1))]
    rows = spark.createDataFrame(seeds, "qid int, chunk_id string, score double").localCheckpoint()
    shuffled()
    got = expand.expand(rows, chunks, edges, params=p).collect()
    assert shuffled() < 8 * n  # chunks and edges; there are 120,000 triples of query, hub and chunk
    for q in range(n_queries):
        mine = {a: s for x, a, s in seeds if x == q}
        by_doc = max(s for a, s in mine.items() if name.index(a) % 2) * 0.6
        score = {a: max(mine[a], by_doc if not i % 2 else 0) if a in mine else max(by_doc if not i % 2 else 0, 0.9 * 0.3) for i, a in enumerate(name)}
        want = sorted(((-round(s, 9), a) for a, s in score.items()))[:10]
        assert [(-r.score, r.chunk_id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == want


def test_computed_vectors_are_worked_out_once(spark):
    """A vector that is a column expression (a text's embedding) is evaluated once a row, though null vectors are left out."""
    from corpusflow.operators import dense

    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(x):
        calls.add(1)
        return None if x == 7 else [float(x), 1.0]

    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, q array<double>")
    got = dense.search(spark.range(40).select("id", embed("id").alias("v")), q, "id", "v", "qid", "q", k=100).collect()
    assert len(got) == 39 and 7 not in {r.id for r in got} and calls.value == 40


def test_chunks_are_worked_out_once(spark, sf):
    """The optimizer repeats no fold, as it does for a filter that it infers from posexplode."""
    from corpusflow.plans import queries

    plans = queries.QUERIES["chunk_documents"](spark, sf)._jdf.queryExecution()
    analyzed, optimized = (p.toString().count("aggregate(") for p in (plans.analyzed(), plans.optimizedPlan()))
    assert optimized == analyzed > 0


def test_packed_groups_equal_the_numbers(spark):
    from corpusflow.operators import chunk

    rng = random.Random(8)
    rows = [([rng.choice([0, 1, 3, 7, 12]) for _ in range(rng.randrange(30))],) for _ in range(200)] + [([],), (None,)]
    d = spark.createDataFrame(rows, "sizes array<int>")
    got = d.select("sizes", chunk.packed(F.col("sizes"), 10, lambda x: x).alias("new"), chunk.grouped(F.col("sizes"), chunk.pack_groups(F.col("sizes"), 10)).alias("old")).collect()
    for r in got:
        want = []
        for x in r.sizes or []:
            if want and sum(want[-1]) + x <= 10:
                want[-1].append(x)
            else:
                want.append([x])
        assert (r.new or []) == r.old == want


def test_answers_shuffle_no_hits(spark, sf, shuffled):
    """Queries over the hits of all benchmark items: their step shuffles each term of the corpus once a task, and no pair of item and document."""
    from corpusflow.plans import queries

    shuffled()
    assert queries.QUERIES["citation_augment"](spark, sf).count() > 0
    assert shuffled() < 40_000  # nearly all of it terms; postings and hits were as much again, twice
