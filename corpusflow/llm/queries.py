"""The registered queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hamming, jaccard, kdtree, language_id, mixing, quality, suffix_dedup, toxicity, url_filter
from .common import fold_of

#: (verdict, host, path) of the url query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good. Selected: P(grade >= 1) of at least a half."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    out = quality.select_by_quality(table(spark, sf_dir, "documents"), labels, fold_of("doc_id", 5) != 0, n_grades=3, tail=1)
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_prob", "selected")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: what is left, as UTF-8; a character of which only some bytes are left becomes U+FFFD. kept_sha256 is that of the bytes."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    return hamming.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=10)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_of_documents(table(spark, sf_dir, "documents"), fold_of("doc_id", 4) != 2)
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_ALL = (op1_kdtree_sharding, op2_quality_classifier, op3_suffix_dedup, op4_url_filter, op5_toxicity, op6_fair_mixing, op7_decontamination, op8_hamming_topk, op9_language_id, op10_jaccard_join)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_REST = "substr(url, position('://' in url) + 3)"
_HOST = f"CASE WHEN coalesce(position('://' in url), 0) = 0 THEN '' ELSE translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END"
_PATH = f"CASE WHEN coalesce(position('://' in url), 0) = 0 THEN '' ELSE regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) END"

#: UTF-8 in hexadecimal digits: a whole character, and the longest beginning of a cut one or a byte out of place.
_NEXT = "[89AB]."
_WHOLE = f"[0-7].|(?:C[2-9A-F]|D.){_NEXT}|(?:E0[AB].|E[1-9ABCEF]{_NEXT}|ED[89].){_NEXT}|(?:F0[9AB].|F[123]{_NEXT}|F48.){_NEXT}{_NEXT}"
_CUT = f"E0[AB].|E[1-9ABCEF]{_NEXT}|ED[89].|(?:F0[9AB].|F[123]{_NEXT}|F48.)(?:{_NEXT})?|.."

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
fits AS (
  SELECT u.page_id, u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule_host) DESC NULLS LAST, length(r.rule_path) DESC) AS place
  FROM u LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op3_suffix_dedup": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT r, i, md5(array_slice(b, i + 1, i + 400)) AS m FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM windows) WHERE n > 1),
begun AS (SELECT r, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS INT) AS fresh FROM again),
spans AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM begun) GROUP BY r, run),
gaps AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS e FROM spans
  UNION ALL SELECT d.r, max(octet_length(d.b)), coalesce(max(spans.e), 0) FROM d LEFT JOIN spans USING (r) GROUP BY d.r),
left_over AS (SELECT r, string_agg(CASE WHEN g.s > g.e THEN hex(array_slice(d.b, g.e + 1, g.s)) ELSE '' END, '' ORDER BY g.s) AS h FROM gaps g JOIN d USING (r) GROUP BY r),
removed AS (SELECT r, sum(e - s) AS n, count(*) AS spans FROM spans GROUP BY r)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed, coalesce(x.spans, 0) AS n_spans, sha256(unhex(l.h)) AS kept_sha256,
  decode(unhex(array_to_string(list_transform(regexp_extract_all(l.h, '{_WHOLE}|{_CUT}'), lambda c: CASE WHEN regexp_full_match(c, '{_WHOLE}') THEN c ELSE 'EFBFBD' END), ''))) AS text
FROM d JOIN left_over l USING (r) LEFT JOIN removed x USING (r)""",
    "op8_hamming_topk": """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0 AND NOT isnan(x), false)) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, CAST(len(list_filter(list_zip(q.bits, c.bits), lambda z: coalesce(z[1], false) <> coalesce(z[2], false))) AS INT) AS distance
      FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS place FROM d) WHERE place <= 10""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM w),
class AS (SELECT min(doc_id) AS doc_id, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
member AS (SELECT x.doc_id, c.doc_id AS class FROM (SELECT doc_id, list_sort(s) AS s FROM sets) x JOIN class c USING (s)),
post AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM class),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM post a JOIN post b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS class, doc_id AS least FROM class UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.class WHERE r.least < l.b),
named AS (SELECT class, min(least) AS component_id FROM reach GROUP BY class)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(n.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN member m USING (doc_id) LEFT JOIN named n USING (class)""",
}
