"""Segmentation of documents into articles, and the policy that keeps, replaces or drops them. Column expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X


@dataclass(frozen=True)
class Patterns:
    """heading: groups number, suffix, title. headers: one group, the label."""

    heading: str = config.HEADING_PATTERN
    headers: dict[str, str] = field(default_factory=lambda: dict(config.HEADER_PATTERNS))
    law_like: str = config.LAW_LIKE_PATTERN
    article_word: str = config.ARTICLE_WORD


def segment(text: Column, patterns: Patterns) -> Column:
    """array<struct(start, stop, number, title, body, levels...)>: each article runs to the next heading or the end."""
    found = X.mark_and_split(text, patterns.heading, 3)
    levels = [X.headers(text, p).alias(name) for name, p in patterns.headers.items()]

    def article(m: Column, all_: Column) -> Column:
        end = m["stop"] + F.length(m["body"])
        return F.struct(
            m["start"].alias("start_char"),
            end.alias("end_char"),
            F.concat(F.lit(patterns.article_word + " "), m["groups"][0], m["groups"][1]).alias("dieu_so"),
            X.strip(m["groups"][2]).alias("dieu_ten"),
            X.strip(m["body"]).alias("noi_dung"),
            *(X.last_before(all_[name], m["start"]).alias(name) for name in patterns.headers),
        )

    return X.let(F.struct(found.alias("found"), *levels), lambda x: F.transform(x["found"], lambda m: article(m, x)))


def outcome(df: DataFrame, patterns: Patterns, limits: config.Limits) -> DataFrame:
    """Adds records (articles to keep), reason (null: no failure) and num_dieu. Needs clean_text, title and ten_van_ban.

    The rules in order: no heading and too short; no heading (kept whole, and a failure where the title sounds like a law);
    headings but no body long enough (too short; a failure for laws; else kept whole); one article of a law (kept, and a
    failure); else the articles.
    """
    bare = X.strip(F.col("clean_text"))
    df = df.withColumn("_articles", segment(F.col("clean_text"), patterns)).withColumn("_records", F.filter("_articles", lambda a: F.length(a["noi_dung"]) >= limits.min_body))
    n, r = F.size("_articles"), F.size("_records")
    law, short = X.law_like(F.col("title"), patterns.law_like), F.length(bare) < limits.min_body
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("ten_van_ban"), F.lit("")), F.lit(config.FALLBACK_TITLE))
    whole = F.array(
        F.struct(F.lit(0).alias("start_char"), F.length(bare).alias("end_char"), F.lit(patterns.article_word + " VB").alias("dieu_so"), title.alias("dieu_ten"), bare.alias("noi_dung"), *(F.lit("").alias(x) for x in patterns.headers))
    )
    none = F.slice(F.col("_records"), 1, 0)
    reason = (
        F.when((r == 0) & short, "text_too_short_after_cleaning").when((n == 0) & law, "zero_dieu_law_like_doc").when((r == 0) & (n > 0) & law, "zero_parsable_dieu_law_like_doc").when((r == 1) & law, "single_dieu_law_like_doc")
    )
    kept = F.when((r == 0) & short, none).when(n == 0, whole).when((r == 0) & law, none).when(r == 0, whole).otherwise(F.col("_records"))
    count = F.when(reason == "zero_parsable_dieu_law_like_doc", n).when(reason == "single_dieu_law_like_doc", 1).otherwise(0)
    return df.withColumns({"records": kept, "reason": reason, "num_dieu": count}).drop("_articles", "_records")


def articles(outcomes: DataFrame, levels: list[str]) -> DataFrame:
    """One row per kept article, in the article schema."""
    a = F.col("a")
    meta = ["law_id", "ten_van_ban", "loai_van_ban", "ngay_ban_hanh", "nganh", "linh_vuc"]
    rows = outcomes.select(F.col("id").cast("string").alias("doc_id"), *meta, F.explode("records").alias("a"))
    uid = F.concat_ws("|", *(F.coalesce(c, F.lit("None")) for c in (F.col("law_id"), F.col("ten_van_ban"), a["dieu_so"])))
    return rows.select("doc_id", *meta, *(a[x].alias(x) for x in [*levels, "dieu_so", "dieu_ten", "noi_dung", "start_char", "end_char"]), uid.alias("doc_uid"))


def failures(outcomes: DataFrame, limits: config.Limits) -> DataFrame:
    return outcomes.filter("reason is not null").select(
        F.col("id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("num_dieu").cast("int").alias("num_dieu"), "reason", F.substring(X.strip(F.col("clean_text")), 1, limits.preview).alias("text_preview")
    )
