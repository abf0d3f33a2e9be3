"""The near-duplicate stage on documents without words, as its own input."""

import corpus_pipeline as P


def test_documents_without_words_each_stay(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long " * 3
    loose = [(None, None, "en", "a", None), (None, None, "de", "b", None), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "", "en", "c", 0), (9, " ", "en", "c", 1)]
    linked = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1)]
    for more, stay in ((linked, linked[:1]), (linked[1:], linked[:1])):
        docs = spark.createDataFrame(loose + more, "doc_id long, text string, lang string, source string, n_chars long")
        got = [tuple(r) for r in P.join_near_duplicates(spark, docs, "").collect()]
        assert sorted(got, key=repr) == sorted(loose + stay, key=repr)
