"""Operators 2, 5 and 9: held-out accuracy on the tables, and defined results."""

import math

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import language_id, quality, queries, toxicity
from corpusflow.llm.common import bounded_sample

DATA = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_language(spark):
    out = queries.op9_language_id(spark, DATA).join(table(spark, "documents"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.98 * out.count()


def test_language_defined_results(spark):
    rows = [(1, "the cat", "en"), (2, "der Hund", "de"), (3, None, "en"), (4, "12 ²!", "en"), (5, "THE dog", None), (6, "", None), (None, "der", None), (5, "the " * 30_000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language_id.language_of_documents(df, F.lit(True)).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (6, "und"), (None, "de")}
    none = language_id.language_of_documents(df, F.lit(False)).collect()
    assert {r.lang_pred for r in none} == {"und"} and all(0 <= r.score <= 1 for r in none)
    assert language_id.language_of_documents(df.limit(0), F.lit(True)).count() == 0


def test_backoff_uses_the_longest_known_gram():
    m = language_id.Model(["a", "b"], {"word": (-1.0, -2.0)}, {"<un": (-3.0, -1.0), "u": (0.0, -9.0)})
    assert m.score_word("word") == (-1.0, -2.0) and m.score_word("unk") == (-3.0, -1.0) and m.score_word("u") == (0.0, -9.0) and m.score_word("zz") is None


def test_toxicity(spark):
    out = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").select("toxic", "score", "predicted").toPandas()
    assert out[out.toxic == 0].predicted.mean() <= 0.02 and out[out.toxic == 1].predicted.mean() >= 0.85


def test_toxicity_defined_results(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9.0), (2, "nice day", 9.0), (3, None, 9.0), (4, "", 9.0), (None, "x", 9.0), (2, "nice day", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (9, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_of_documents(docs, labels, F.lit(True)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (3, 4)}) == 1
    assert {r.score for r in toxicity.toxicity_of_documents(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert toxicity.toxicity_of_documents(docs.limit(0), labels, F.lit(True)).count() == 0


def test_quality(spark):
    out = queries.op2_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").select("quality", "selected", "expected_grade").toPandas()
    assert out[out.quality == 1].selected.mean() >= 0.98 and out[out.quality == 0].selected.mean() <= 0.1
    assert out[out.quality == 1].expected_grade.mean() > out[out.quality == 0].expected_grade.mean() + 0.5


def test_quality_model_is_ordinal():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 600)
    rows = [(np.array([0, 1]), np.array([0.1 + 0.3 * g, 0.9 - 0.3 * g]) + rng.normal(0, 0.05, 2)) for g in grades]
    m = quality.fit(rows, grades, 3, 4)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(np.array([-5.0, 0.0, 5.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails[:, 0]) > 0).all()
    s = np.array([(m.weights[p] * v).sum() for p, v in rows])
    assert s[grades == 0].mean() < s[grades == 1].mean() < s[grades == 2].mean()


def test_quality_defined_results(spark):
    docs = spark.createDataFrame([(1, "good text", 1), (2, "BAD!! $$$", 1), (3, None, 1), (4, "ab", 1), (None, "good text", 1)], "doc_id long, text string, tail_prob int")
    ratings = spark.createDataFrame([(1, 2), (2, 0), (3, None), (1, 1)], "doc_id long, grade int")
    out = quality.select_by_quality(docs, ratings, F.lit(True), 3, 1).collect()
    assert len(out) == 5 and len({r.tail_prob for r in out if r.doc_id in (3, 4)}) == 1
    assert len({round(r.tail_prob, 9) for r in quality.select_by_quality(docs, ratings.limit(0), F.lit(True), 3, 1).collect()}) == 1
    assert quality.select_by_quality(docs.limit(0), ratings, F.lit(True), 3, 1).count() == 0


def test_the_sample_is_bounded(spark):
    """One text in half of all rows, one doc_id in a third, and long texts: never more rows or bytes than asked."""
    docs = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.repeat(F.lit(" long"), (F.col("id") % 7 * 200).cast("int")))).alias("text"))
    labels = spark.range(0, 3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    for rows, size in ((100, 1 << 20), (2000, 30_000), (10, 3)):
        got = bounded_sample(docs, labels, rows, size).toPandas()
        assert 0 < len(got) <= rows and sum(len(t.encode()) for t in got.text) <= size and not got.duplicated(["key", "label"]).any()
        again = bounded_sample(docs.repartition(7), labels, rows, size).toPandas()
        assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))
    own = bounded_sample(docs.withColumn("label", F.lit("x")), None, 50, 10_000).toPandas()
    assert 0 < len(own) <= 50 and set(own.label) == {"x"}


def test_ftrl_like_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 16, 5)).astype(np.int32) for _ in range(60)]
    labels = np.array([float(3 in r) for r in rows])
    learner = toxicity.Ftrl(bits=4, alpha=0.5, l1=0.3, l2=0.1)
    weights, bias = learner.fit(rows, labels, epochs=2)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    weight = lambda zi, ni, l1, l2: 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((1 + math.sqrt(ni)) / 0.5 + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(60):
            ws, b = {j: weight(z[j], n[j], 0.3, 0.1) for j in rows[i]}, weight(zb, nb, 0, 0)
            g = 1 / (1 + math.exp(-(sum(ws.values()) + b))) - labels[i]
            for j, w in ws.items():
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / 0.5 * w
                n[j] += g * g
            zb, nb = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / 0.5 * b, nb + g * g
    assert np.allclose(weights, [weight(a, c, 0.3, 0.1) for a, c in zip(z, n)], atol=1e-6) and abs(bias - weight(zb, nb, 0, 0)) < 1e-9


def test_slopes_of_the_likelihood():
    rng = np.random.default_rng(2)
    s, grades, theta = rng.normal(size=9), rng.integers(0, 4, 9), np.array([-1.0, 0.2, 1.5])
    _, by_s, by_theta = quality.likelihood(s, grades, theta)
    small = 1e-6
    for i in range(9):
        step = np.eye(9)[i] * small
        assert abs((quality.likelihood(s + step, grades, theta)[0] - quality.likelihood(s - step, grades, theta)[0]) / (2 * small) - by_s[i]) < 1e-6
    for k in range(3):
        step = np.eye(3)[k] * small
        assert abs((quality.likelihood(s, grades, theta + step)[0] - quality.likelihood(s, grades, theta - step)[0]) / (2 * small) - by_theta[k]) < 1e-6


def test_scores_like_plain_code(spark):
    """Long texts, over one piece of bytes, repeated rows, a name that differs in case only."""
    texts = ["you idiot you", "a b c d", "x " * 700_000 + "idiot", "", None, "a b c d"]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, TEXT string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.toxicity_of_documents(docs, labels, F.lit(True)).collect()}
    assert len(out) == 6 and out[1] == out[5] and out[3] == out[4]
    weights = np.zeros(1 << 8, np.float32)
    weights[::3] = 0.25
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights, -0.5).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        place = set(toxicity.features(data, np.array([0, len(data)]), 8)[1].tolist())
        assert abs(got[i] - 1 / (1 + math.exp(-(sum(float(weights[p]) for p in place) - 0.5)))) < 1e-6


def test_language_like_a_dictionary(spark):
    """The model's scores by plain counting; a tie goes to the first language."""
    rows = [(1, "aa bb", "x"), (2, "aa cc", "y"), (3, "bb bb", "x"), (4, "bb bb", "x")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.train(train)
    assert m.languages == ["x", "y"] and set(m.word_scores) == {"aa", "bb", "cc"}
    assert np.allclose(m.word_scores["bb"], (math.log(5.5 / 1006), math.log(0.5 / 1002)))
    assert m.predict("zz", {})[0] == "x" and m.predict("aa", {})[0] == "y" and m.predict("bbb", {})[0] == "x"
