"""Precision, recall and F2 of predicted against gold lists, per question and as macro means; grounding of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def scores(predicted: Column, gold: Column, beta: float = 2.0) -> dict[str, Column]:
    """Two empty lists score 1, one empty list 0, no overlap 0. Repeats don't count."""
    none = F.array().cast("array<string>")
    p, g = F.array_distinct(F.coalesce(predicted, none)), F.array_distinct(F.coalesce(gold, none))
    hit = F.size(F.array_intersect(p, g)).cast("double")
    both, one = (F.size(p) == 0) & (F.size(g) == 0), (F.size(p) == 0) | (F.size(g) == 0)
    rule = lambda c: F.when(both, 1.0).when(one, 0.0).otherwise(c)
    precision, recall = hit / F.size(p), hit / F.size(g)
    f = F.when(hit == 0, 0.0).otherwise((1 + beta**2) * precision * recall / (beta**2 * precision + recall))
    return {"precision": rule(precision), "recall": rule(recall), "f2": rule(f)}


def per_question(predictions: DataFrame, gold: DataFrame, column: str = "relevant_articles") -> DataFrame:
    """id, precision, recall, f2; paired by id. A question without a prediction has an empty list."""
    both = gold.select("id", F.col(column).alias("_g")).join(predictions.select("id", F.col(column).alias("_p")), "id", "left")
    return both.select("id", *(c.alias(n) for n, c in scores(F.col("_p"), F.col("_g")).items()))


def macro(questions: DataFrame) -> DataFrame:
    return questions.agg(F.count("*").alias("n_questions"), *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f2")))


def grounding(answers: DataFrame, known: DataFrame, pattern: str = r"(?iuU)điều\s+\d+[a-zđ]?") -> DataFrame:
    """One row: answers, those with a citation, and the share whose citations are all among their known articles.

    answers: id, answer. known: id, relevant_articles (law|name|article).
    """
    low = lambda c: F.lower(c)
    rows = answers.join(known.select("id", F.transform("relevant_articles", lambda x: low(F.element_at(F.split(x, r"\|"), -1))).alias("_known")), "id", "left")
    cited = F.transform(F.regexp_extract_all("answer", F.lit(f"({pattern})"), F.lit(1)), lambda x: low(x))
    ok = (F.size(cited) > 0) & (F.size(F.array_except(cited, F.coalesce("_known", F.array().cast("array<string>")))) == 0)
    return rows.agg(F.count("*").alias("n_answers"), F.count_if(F.size(cited) > 0).alias("n_cited"), F.round(F.avg(ok.cast("int")), 6).alias("grounding_rate"))


def blank(c: Column) -> Column:
    return F.coalesce(X.strip(c), F.lit("")) == ""
