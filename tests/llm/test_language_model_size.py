"""Entries of the language model with equal counts share their scores, on the workers too."""

import pickle

from corpusflow.llm import language_id


def test_equal_counts_share_their_scores(spark):
    rows = [(1, "der hund und die katze und der vogel", "de"), (2, "the dog and the cat and the bird", "en")]
    sent = pickle.loads(pickle.dumps(language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))))
    scores = list(sent.word_scores.values())
    assert len(scores) == 11 and len({id(x) for x in scores}) == len(set(scores)) < 11
