"""From hits to a submitted answer: rerank, contexts, citations, guardrails, fallback, records and their validation.

Hits: qid, rank (from 1), chunk_id and the enriched chunk's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..models import Reranker, lexical_overlap
from . import dedup


def rerank(candidates: DataFrame, question: str = "question", text: str = "enriched_text", k: int = 5, score: Reranker = lexical_overlap, most_chars: int = 2000) -> DataFrame:
    """candidates: qid, chunk_id, question, text. Adds rerank_score and rank, and keeps the k best of each question."""
    scored = candidates.withColumn("rerank_score", F.round(score(F.col(question), F.substring(F.col(text), 1, most_chars)), 6))
    return dedup.top_k(scored, ["qid"], [F.col("rerank_score").desc(), F.col("chunk_id").asc()], k)


def in_rank_order(hits: DataFrame, item: Column, mark: str, most: int | None = None) -> Column:
    """An aggregate: items joined in rank order. Hits of a question are few (the final k)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return F.array_join(F.transform(F.slice(ordered, 1, most) if most else ordered, lambda x: x["item"]), mark)


def contexts(hits: DataFrame, most_chars: int = 1500) -> DataFrame:
    """qid, contexts: numbered blocks with name, article, summary and the start of the body."""
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), c("ten_van_ban"), F.lit(" — "), c("dieu_so"), F.lit(": "), c("dieu_ten"), F.lit("\nTóm tắt: "), c("short"), F.lit("\nNội dung: "), F.substring(c("noi_dung"), 1, most_chars))
    return hits.groupBy("qid").agg(in_rank_order(hits, block, "\n\n").alias("contexts"))


def graph_contexts(hits: DataFrame, edges: DataFrame, documents: DataFrame, shown: tuple[str, ...] = config.SHOWN_RELATIONS, none: str = config.NO_RELATIONS) -> DataFrame:
    """qid, graph_context: a bullet for each shown relation of the hits' documents. documents: node_id, name."""
    docs = hits.select("qid", F.concat(F.lit("DOC:"), F.col("doc_id").cast("string")).alias("src")).distinct()
    near = docs.join(edges.filter(F.col("rel").isin(list(shown))).select("src", "dst", "rel").distinct(), "src").join(documents.select(F.col("node_id").alias("dst"), "name"), "dst")
    line = F.concat(F.lit("• "), "rel", F.lit(": "), "name")
    lists = near.select("qid", line.alias("line")).distinct().groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("graph_context"))
    return hits.select("qid").distinct().join(lists, "qid", "left").withColumn("graph_context", F.coalesce("graph_context", F.lit(none)))


def prompts(questions: DataFrame, hits: DataFrame, edges: DataFrame, documents: DataFrame, most_chars: int = 1500) -> DataFrame:
    """qid, system, prompt of every question with hits. questions: id, question."""
    k = hits.groupBy("qid").agg(F.count("*").cast("string").alias("k"))
    rows = contexts(hits, most_chars).join(graph_contexts(hits, edges, documents), "qid").join(k, "qid")
    rows = rows.join(questions.select(F.col("id").alias("qid"), F.coalesce("question", F.lit("")).alias("question")), "qid")
    c = F.col
    return rows.select("qid", F.lit(config.ANSWER_SYSTEM).alias("system"), X.filled(config.ANSWER_PROMPT, question=c("question"), K=c("k"), contexts=c("contexts"), graph_context=c("graph_context")).alias("prompt"))


def _cited(answer: Column, number: Column, strict: bool) -> Column:
    if strict:  # 'Điều 1' is not found inside 'Điều 13'
        return F.rlike(answer, F.concat(F.lit("(?iuU)"), X.quoted(number), F.lit("(?![0-9a-zđ])")))
    return F.contains(answer, number)


def add_citations(answers: DataFrame, hits: DataFrame, strict: bool = False) -> DataFrame:
    """Appends a line for every hit whose article the answer doesn't name. answers: qid, answer, ..."""
    per_hit = answers.select("qid", "answer").join(hits.select("qid", "rank", "dieu_so", "ten_van_ban"), "qid").filter(~_cited(F.col("answer"), F.col("dieu_so"), strict))
    line = F.concat(F.lit("\n(Căn cứ bổ sung: "), "dieu_so", F.lit(" của "), "ten_van_ban", F.lit(")"))
    more = per_hit.groupBy("qid").agg(in_rank_order(per_hit, line, "").alias("_more"))
    return answers.join(more, "qid", "left").withColumn("answer", F.concat("answer", F.coalesce("_more", F.lit("")))).drop("_more")


def guardrails(answers: DataFrame, hits: DataFrame, min_chars: int = 200, strict_numbers: bool = False, strict_citations: bool = False) -> DataFrame:
    """Adds v01..v04, passed and reasons; an answer without a disclaimer gets one (after v03 is judged).

    A law number counts as known if it equals a hit's, or (unless strict) begins one: the pattern stops before digits.
    """
    per = hits.groupBy("qid").agg(F.collect_set("dieu_so").alias("_articles"), F.collect_set("law_id").alias("_laws"))
    rows = answers.join(per, "qid", "left")
    none = F.array().cast("array<string>")
    articles, laws = F.coalesce("_articles", none), F.coalesce("_laws", none)
    known = (lambda law, x: law == x) if strict_numbers else (lambda law, x: F.startswith(law, x))
    checks = {
        "v01": F.exists(articles, lambda a: _cited(F.col("answer"), a, strict_citations)),
        "v02": F.forall(X.law_numbers(F.col("answer")), lambda x: F.exists(laws, lambda law: known(law, x))),
        "v03": F.col("answer").contains(config.DISCLAIMER_MARKS[0]) | F.col("answer").contains(config.DISCLAIMER_MARKS[1]),
        "v04": F.length("answer") >= min_chars,
    }
    names = {"v01": "V01_has_citation", "v02": "V02_no_fabricated_law_id", "v03": "V03_has_disclaimer", "v04": "V04_min_length"}
    rows = rows.withColumns(checks)
    rows = rows.withColumn("passed", F.col("v01") & F.col("v02") & F.col("v04"))
    rows = rows.withColumn("reasons", F.concat_ws(",", *(F.when(~F.col(v), F.lit(n)) for v, n in names.items())))
    return rows.withColumn("answer", F.when(F.col("v03"), F.col("answer")).otherwise(F.concat("answer", F.lit("\n" + config.DISCLAIMER)))).drop("_articles", "_laws")


def fallback_answers(hits: DataFrame, top: int = 3, most_chars: int = 200) -> DataFrame:
    """qid, answer: a bullet for each of the best hits, with its summary or the start of its body."""
    said = F.when(F.coalesce(F.col("short"), F.lit("")) != "", F.col("short")).otherwise(F.substring(F.coalesce("noi_dung", F.lit("")), 1, most_chars))
    bullet = F.concat(F.lit("- **"), "dieu_so", F.lit(" của "), "ten_van_ban", F.lit("**: "), said)
    body = hits.groupBy("qid").agg(in_rank_order(hits, bullet, "\n", top).alias("_body"))
    return body.select("qid", F.concat(F.lit("**Tổng hợp từ căn cứ pháp luật:**\n\n"), "_body", F.lit("\n\n*" + config.DISCLAIMER + "*")).alias("answer"))


def answered(answers: DataFrame, hits: DataFrame, **options) -> DataFrame:
    """Generated answers with citations and guardrails; those that fail are replaced by the fallback.

    Decoding is greedy, so a retry with the same prompt would give the same answer: failing once is failing always.
    """
    judged = guardrails(add_citations(answers, hits), hits, **options)
    spare = fallback_answers(hits).withColumnRenamed("answer", "_spare")
    return judged.join(spare, "qid", "left").withColumn("answer", F.when(F.col("passed"), F.col("answer")).otherwise(F.coalesce("_spare", "answer"))).drop("_spare")


def submission(questions: DataFrame, answers: DataFrame, hits: DataFrame) -> DataFrame:
    """id, question, answer, relevant_docs, relevant_articles: lists in rank order, without repeats."""
    doc = F.concat_ws("|", "law_id", "ten_van_ban")
    ordered = F.array_sort(F.collect_list(F.struct("rank", doc.alias("doc"), F.concat_ws("|", doc, "dieu_so").alias("article"))))
    lists = hits.groupBy("qid").agg(ordered.alias("_h"))
    lists = lists.select(F.col("qid").alias("id"), F.array_distinct(F.transform("_h", lambda x: x["doc"])).alias("relevant_docs"), F.array_distinct(F.transform("_h", lambda x: x["article"])).alias("relevant_articles"))
    none = F.array().cast("array<string>")
    out = questions.select("id", "question").join(answers.select(F.col("qid").alias("id"), "answer"), "id", "left").join(lists, "id", "left")
    return out.select("id", "question", "answer", F.coalesce("relevant_docs", none).alias("relevant_docs"), F.coalesce("relevant_articles", none).alias("relevant_articles"))


def violations(results: DataFrame, questions: DataFrame, min_chars: int = 200, article_word: str = config.ARTICLE_WORD) -> DataFrame:
    """id, rule: a row for each rule that a record, or its absence, breaks."""
    counts = results.groupBy("id").agg(F.count("*").alias("_n"))
    rows = results.join(counts, "id", "left").join(questions.select("id", F.lit(True).alias("_asked")), "id", "left")
    numbers = F.transform("relevant_articles", lambda x: F.element_at(F.split(x, r"\|"), -1))
    rules = {
        "missing_field": F.col("id").isNull() | F.col("question").isNull() | F.col("answer").isNull() | F.col("relevant_docs").isNull() | F.col("relevant_articles").isNull(),
        "duplicate_id": F.col("_n") > 1,
        "unknown_id": F.col("_asked").isNull(),
        "bad_doc": F.exists("relevant_docs", lambda x: X.separators(x) != 1),
        "bad_article": F.exists("relevant_articles", lambda x: (X.separators(x) != 2) | ~F.startswith(F.element_at(F.split(x, r"\|"), -1), F.lit(article_word))),
        "repeated_item": (F.size(F.array_distinct("relevant_docs")) < F.size("relevant_docs")) | (F.size(F.array_distinct("relevant_articles")) < F.size("relevant_articles")),
        "short_answer": F.length("answer") < min_chars,
        "no_citation": ~F.exists(numbers, lambda x: F.contains(F.col("answer"), x)),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in rules.items())), lambda x: x.isNotNull())
    broken = rows.select("id", F.explode(found).alias("rule")).distinct()
    missing = questions.select("id").join(results.select("id"), "id", "left_anti").select("id", F.lit("missing_record").alias("rule"))
    return broken.unionByName(missing)
