"""Registered queries: the operators over the general tables, each with its SQL where SQL can say it.

Driver tables stand in for the legal ones; patterns and lists that the legal defaults would not find there are passed in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..functions.html import html_to_text
from ..models import first_sentence_summary
from ..operators import answer, chunk, dedup, dense, diagnose, enrich, evaluate, expand, fuse, gates, graph, joins, lexical, scope, segment
from ..scratch import Scratch
from ..sources import readers, sinks
from . import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- scope, predicates, projections --------------------------------------------------------------

SCOPE = config.Scope(title_keywords=("thea", "Schö"), fields=("src1", "src2", "src3"), sectors=("es",), document_types=("en", "de", "es", "None"), status=".", least_rows=1, most_rows=10**9)
SCOPE_COLUMNS = scope.ScopeColumns(id="doc_id", title="text", kind="lang", number="source", field="source", sector="lang", status="text")
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ANY_WORD = "(contains(lower(text), 'thea') OR contains(lower(text), 'schö'))"


@query(f"""
WITH kept AS (
  SELECT doc_id, source AS law_id, {STRIP.format("lang || ' ' || source || ' ' || " + STRIP.format("regexp_replace(" + STRIP.format("text") + r", '^[-–:]\s*', '')"))} AS ten_van_ban
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    AND ({ANY_WORD} OR source IN ('src1', 'src2', 'src3') OR lang = 'es') AND contains(text, '.') AND coalesce(lang, 'None') IN ('en', 'de', 'es', 'None'))
SELECT min(doc_id) AS doc_id, law_id, md5(ten_van_ban) AS name_md5, length(ten_van_ban) AS name_length FROM kept GROUP BY law_id, ten_van_ban""")
def scope_filter(spark, sf_dir):
    out = scope.scope_filter(T(spark, sf_dir, "documents"), T(spark, sf_dir, "labels"), SCOPE, SCOPE_COLUMNS)
    return out.select("doc_id", "law_id", F.md5("ten_van_ban").alias("name_md5"), long(F.length("ten_van_ban")).alias("name_length"))


@query(f"SELECT doc_id, {ANY_WORD} AS hit FROM documents")
def multi_keyword_any(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.contains_any(F.col("text"), SCOPE.title_keywords).alias("hit"))


@query("SELECT doc_id FROM documents WHERE coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'None') IN ('en', 'None')")
def in_list_null_safe(spark, sf_dir):
    """French becomes null here, and a null counts as the listed word None."""
    docs = T(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("lang") != "fr", F.col("lang")))
    return docs.filter(scope.in_list_null_as_none(F.col("kind"), ("en", "None"))).select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(p_type, 'AND')")
def substring_status(spark, sf_dir):
    return T(spark, sf_dir, "part").filter(scope.has_status(F.col("p_type"), "AND")).select("p_partkey")


@query(r"SELECT doc_id, regexp_matches(source, '\b(src1|src2)\b') AS law_like FROM documents")
def law_like_title(spark, sf_dir):
    return T(spark, sf_dir, "documents").select("doc_id", X.law_like(F.col("source"), r"\b(src1|src2)\b").alias("law_like"))


@query("SELECT p_partkey, trim(p_type || ' ' || p_brand || ' ' || p_name) AS full_name, p_name AS clean FROM part")
def clean_title_prefix(spark, sf_dir):
    """The title repeats type and brand, which cleaning takes off again."""
    p = T(spark, sf_dir, "part").withColumn("title", F.concat(F.upper("p_type"), F.lit(" "), "p_brand", F.lit(" - "), "p_name"))
    parts = F.col("p_type"), F.col("p_brand"), F.col("title")
    return p.select("p_partkey", X.full_name(*parts).alias("full_name"), X.clean_title(parts[2], parts[0], parts[1]).alias("clean"))


@query("SELECT doc_id, substr(text, 1, 200) AS preview FROM documents ORDER BY doc_id LIMIT 50")
def head_preview(spark, sf_dir):
    return T(spark, sf_dir, "documents").orderBy("doc_id").limit(50).select("doc_id", F.substring("text", 1, 200).alias("preview"))


# --- joins ---------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_content(spark, sf_dir):
    return joins.having_content(T(spark, sf_dir, "documents"), T(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_uncached(spark, sf_dir):
    return joins.not_cached(T(spark, sf_dir, "documents"), T(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_default_join(spark, sf_dir):
    return joins.with_defaults(T(spark, sf_dir, "documents"), T(spark, sf_dir, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)}).select("doc_id", "quality", "toxic")


@query("SELECT d.doc_id, d.doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents d")
def mark_join(spark, sf_dir):
    return joins.marked(T(spark, sf_dir, "documents"), T(spark, sf_dir, "labels"), "doc_id", "labelled").select("doc_id", "labelled")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) AND l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def both_ends_in_scope(spark, sf_dir):
    nodes = T(spark, sf_dir, "supplier").filter("s_nationkey < 12")
    return joins.both_ends_in(T(spark, sf_dir, "lineitem"), nodes, "l_suppkey", "l_partkey", "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'AMENDS' WHEN 'R' THEN 'REPLACES' ELSE l_returnflag END AS rel, count(*) AS n_edges FROM lineitem GROUP BY 1")
def label_map(spark, sf_dir):
    return T(spark, sf_dir, "lineitem").groupBy(joins.mapped(F.col("l_returnflag"), {"A": "AMENDS", "R": "REPLACES"}).alias("rel")).agg(F.count("*").alias("n_edges"))


# --- dedup, gates, counts -------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, lang, source FROM documents GROUP BY lang, source")
def dedup_first(spark, sf_dir):
    return dedup.keep_first(T(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS place FROM documents) WHERE place = 1")
def dedup_longest(spark, sf_dir):
    return dedup.keep_longest(T(spark, sf_dir, "documents"), ["lang", "source"], "text", ["doc_id"]).select("doc_id", "lang", "source")


@query("""
SELECT conv_id, turn, role, said FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY fix DESC, turn DESC) AS place FROM (
    SELECT conv_id, turn, role, md5(text) AS said, 0 AS fix FROM conversations
    UNION ALL SELECT conv_id, turn, 'fixed', md5(text), 1 FROM conversations WHERE turn = 0 AND conv_id % 3 = 0)) WHERE place = 1""")
def override_last(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("said"))
    return dedup.override_last(c, c.filter("turn = 0 and conv_id % 3 = 0").withColumn("role", F.lit("fixed")), ["conv_id"], ["turn"])


@query("""
SELECT 'orders' AS tbl, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS n_duplicated FROM orders
UNION ALL SELECT 'texts', count(*), count(DISTINCT text), (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) FROM documents""")
def quality_gate_report(spark, sf_dir):
    orders = gates.key_report(T(spark, sf_dir, "orders"), ["o_orderkey"]).withColumn("tbl", F.lit("orders"))
    texts = gates.key_report(T(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("t")), ["t"]).withColumn("tbl", F.lit("texts"))
    return orders.unionByName(texts).select("tbl", "n_rows", "n_keys", "n_duplicated")


@query("SELECT md5(text) AS text_md5, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return gates.duplicate_groups(T(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), ["text_md5"])


@query("SELECT key, count(*) AS n_tables FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key, 'd' AS t FROM documents UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'l' FROM labels) GROUP BY key HAVING count(*) < 2")
def alignment_gate(spark, sf_dir):
    return gates.alignment({"documents": T(spark, sf_dir, "documents"), "labels": T(spark, sf_dir, "labels")}, "doc_id")


REASONS = "SELECT doc_id, CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 1500 THEN 'medium' ELSE 'long' END AS reason FROM documents"


def _reasons(spark, sf_dir):
    return T(spark, sf_dir, "documents").withColumn("reason", F.when(F.length("text") < 300, "short").when(F.length("text") < 1500, "medium").otherwise("long"))


@query(f"SELECT reason, count(*) AS n_failures FROM ({REASONS}) GROUP BY reason ORDER BY 2 DESC, 1")
def outcome_histogram(spark, sf_dir):
    return diagnose.histogram(_reasons(spark, sf_dir))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total_failures, string_agg(reason || '=' || n, ',' ORDER BY reason) AS by_reason FROM (SELECT reason, count(*) AS n FROM ({REASONS}) GROUP BY reason)")
def outcome_summary_map(spark, sf_dir):
    s = diagnose.summary(_reasons(spark, sf_dir))
    return s.select("total_failures", F.array_join(F.transform(F.array_sort(F.map_entries("by_reason")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("by_reason"))


@query("SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT text) AS n_texts, round(avg(CASE WHEN contains(text, '?') THEN 1 ELSE 0 END), 6) AS question_rate FROM documents")
def distinct_counts(spark, sf_dir):
    return T(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct("text").alias("n_texts"), F.round(F.avg(F.col("text").contains("?").cast("int")), 6).alias("question_rate"))


@query()
def stratified_sample(spark, sf_dir):
    return diagnose.stratified_sample(T(spark, sf_dir, "documents"), "lang", "doc_id", 20).select("doc_id", "lang")


# --- text ----------------------------------------------------------------------------------------


@query()
def html_text(spark, sf_dir):
    pages = T(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))
    return pages.select("page_id", X.clean_text(F.col("text")).alias("text"))


MESSY = "chr(9) || text || '  ' || chr(10) || chr(10) || text || chr(10)"
CLEAN = rf"regexp_replace(regexp_replace({MESSY}, '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')"


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split({CLEAN}, chr(10))) AS line, generate_subscripts(string_split({CLEAN}, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS clean_md5, count(*) AS n_lines FROM k WHERE before IS NULL OR before <> line GROUP BY doc_id""")
def normalise_lines(spark, sf_dir):
    messy = F.concat(F.lit("\t"), "text", F.lit("  \n\n"), "text", F.lit("\n"))
    d = T(spark, sf_dir, "documents").select("doc_id", X.clean_text(messy).alias("c"))
    return d.select("doc_id", F.md5("c").alias("clean_md5"), long(F.size(F.split("c", "\n", -1))).alias("n_lines"))


@query(f"SELECT doc_id, {STRIP.format('chr(10) || chr(9) || text || chr(13) || chr(32)')} = {STRIP.format('text')} AS same, length({STRIP.format('text')}) AS n FROM documents")
def py_strip(spark, sf_dir):
    d = T(spark, sf_dir, "documents")
    return d.select("doc_id", (X.strip(F.concat(F.lit("\n\t"), "text", F.lit("\r "))) == X.strip(F.col("text"))).alias("same"), long(F.length(X.strip(F.col("text")))).alias("n"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"
PLACED = f"SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM ({LINES})"
EVERY_LINE = r"^([^\s])()(.*)$"


@query(f"""
SELECT doc_id, pos AS start_char, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY i), total) AS end_char, md5({STRIP.format("substr(line, 2)")}) AS title_md5
FROM (SELECT p.*, length(d.text) AS total FROM ({PLACED}) p JOIN documents d USING (doc_id)) WHERE regexp_matches(line, '^\\S')""")
def segment_spans(spark, sf_dir):
    """Every line that doesn't begin with a space is a heading; spans run to the next."""
    d = T(spark, sf_dir, "documents").select("doc_id", F.explode(segment.segment(F.col("text"), segment.Patterns(heading=EVERY_LINE, headers={}))).alias("a"))
    return d.select("doc_id", long("a.start_char").alias("start_char"), long("a.end_char").alias("end_char"), F.md5("a.dieu_ten").alias("title_md5"))


@query(f"""
SELECT doc_id, pos AS start_char, coalesce(last_value(CASE WHEN regexp_matches(line, '^[A-Ea-e]') THEN regexp_extract(line, '^\\S+') END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS header
FROM ({PLACED}) WHERE regexp_matches(line, '^\\S')""")
def asof_header(spark, sf_dir):
    """The last line before each line that begins with a letter from A to E: its first word."""
    p = segment.Patterns(heading=EVERY_LINE, headers={"header": r"^([A-E]\S*).*$"})
    d = T(spark, sf_dir, "documents").select("doc_id", F.explode(segment.segment(F.col("text"), p)).alias("a"))
    return d.select("doc_id", long("a.start_char").alias("start_char"), F.col("a.header").alias("header"))


@query(f"SELECT doc_id, length(text) AS n_chars, max(pos) AS last_start FROM ({PLACED}) JOIN documents USING (doc_id) WHERE regexp_matches(line, '^\\S') GROUP BY ALL")
def last_span_end(spark, sf_dir):
    a = segment.segment(F.col("text"), segment.Patterns(heading=EVERY_LINE, headers={}))
    d = T(spark, sf_dir, "documents").select("doc_id", F.try_element_at(a, F.lit(-1)).alias("a")).filter("a is not null")
    return d.select("doc_id", long("a.end_char").alias("n_chars"), long("a.start_char").alias("last_start"))


def _policy_sql(docs: str, more: str = "") -> str:
    """What becomes of the documents of a table (doc_id, source, text), and ``more`` columns of it. Headings: lines that begin with a word from A to E."""
    lines = LINES.replace("FROM documents", f"FROM {docs}")
    return rf"""
WITH m AS (SELECT doc_id, line, i, regexp_matches(line, '^[A-Ea-e][\pL\pN_]* ') AS head FROM ({lines})),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m),
b AS (SELECT doc_id, part, {STRIP.format("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '')")} AS body FROM g WHERE part > 0 GROUP BY doc_id, part),
s AS (SELECT d.doc_id, {STRIP.format("d.text")} AS bare{more}, regexp_matches(d.source, '\b(src1|src2|src3|src4)\b') AS law, count(b.part) AS n, count(*) FILTER (WHERE length(b.body) >= 30) AS r, coalesce(sum(length(b.body)) FILTER (WHERE length(b.body) >= 30), 0) AS chars
      FROM {docs} d LEFT JOIN b USING (doc_id) GROUP BY ALL),
o AS (SELECT *, CASE WHEN r = 0 AND length(bare) < 30 THEN 'text_too_short_after_cleaning' WHEN n = 0 AND law THEN 'zero_dieu_law_like_doc' WHEN r = 0 AND n > 0 AND law THEN 'zero_parsable_dieu_law_like_doc' WHEN r = 1 AND law THEN 'single_dieu_law_like_doc' END AS reason FROM s)
SELECT doc_id, reason, CASE reason WHEN 'zero_parsable_dieu_law_like_doc' THEN n WHEN 'single_dieu_law_like_doc' THEN 1 ELSE 0 END AS num_dieu,
  CASE WHEN reason IN ('text_too_short_after_cleaning', 'zero_parsable_dieu_law_like_doc') THEN 0 WHEN r = 0 THEN 1 ELSE r END AS n_records,
  CAST(CASE WHEN reason IN ('text_too_short_after_cleaning', 'zero_parsable_dieu_law_like_doc') THEN 0 WHEN r = 0 THEN length(bare) ELSE chars END AS BIGINT) AS n_chars{", clean_md5" if more else ""} FROM o"""


POLICY = segment.Patterns(heading=r"^([A-E]\w*)( )(.*)$", headers={}, law_like=r"\b(src1|src2|src3|src4)\b")


def _policy_columns() -> list[F.Column]:
    chars = F.aggregate("records", F.lit(0), lambda s, a: s + F.length(a["noi_dung"]))
    return [F.col("reason"), long("num_dieu").alias("num_dieu"), long(F.size("records")).alias("n_records"), long(chars).alias("n_chars")]


@query(_policy_sql("documents"))
def keep_drop_policy(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("clean_text"), F.col("source").alias("title"), F.col("source").alias("ten_van_ban"))
    return segment.outcome(d, POLICY, config.Limits()).select("doc_id", *_policy_columns())


_STRIPPED = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
_CLEANED = rf"""(SELECT doc_id, source, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS k, array_to_string(k, chr(10)) AS text, md5(array_to_string(k, chr(10))) AS clean_md5
  FROM (SELECT doc_id, source, list_transform({_STRIPPED}, lambda x: regexp_replace(x, '[ \t]+', ' ', 'g')) AS l FROM documents WHERE doc_id % 4 <> 1))"""


@query(_policy_sql(_CLEANED, ", d.clean_md5"))
def parse_content(spark, sf_dir):
    """The parse stage on made-up pages: every line of a text is a paragraph, in markup with hidden parts and character references.

    Metadata has three documents in four. Every fifth document's body comes after an empty and a null one, and before another;
    every seventh has it in ``content``.
    """
    d, line = T(spark, sf_dir, "documents"), F.lit("</p>\n<p class='x'>")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&eacute;"))
    page = F.concat(F.lit("<html><head><style>p{}</style></head><body><!-- c --><script>if (1 < 2) x()</script><p>"), F.replace(escaped, F.lit("\n"), line), F.lit("</p></body></html>"))
    rest = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(""), F.lit(None).cast("string"), page, F.lit("<p>later</p>"))).otherwise(F.array(page))
    rows = d.select(F.col("doc_id").alias("id"), F.explode(rest).alias("html"))
    seventh = F.col("id") % 7 == 0
    content = rows.select("id", F.when(~seventh, F.col("html")).alias("content_html"), F.when(seventh, F.col("html")).otherwise("unused").alias("content"))
    content = content.withColumn("content", F.when(F.col("content_html").isNull() & ~seventh, None).otherwise(F.when((F.col("content_html") == "") & ~seventh, "").otherwise(F.col("content"))))
    scoped = d.filter("doc_id % 4 <> 1").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("source").alias("ten_van_ban"))
    out = stages.parse_documents(scoped, content, POLICY)
    return out.select(F.col("id").alias("doc_id"), *_policy_columns(), F.md5("clean_text").alias("clean_md5"))


SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len({SENTENCES}) AS n_sentences, md5(array_to_string({SENTENCES}, '|')) AS sentences_md5 FROM documents")
def sentence_split(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", long(F.size("s")).alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_clauses FROM documents")
def clause_split(spark, sf_dir):
    numbered = F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit("\n2. ")))
    return T(spark, sf_dir, "documents").select("doc_id", long(F.size(X.clauses(numbered))).alias("n_clauses"))


TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(b // 50 AS BIGINT) AS block, array_to_string(list_slice(t, b + 1, b + 50), ' ') AS text FROM (SELECT doc_id, t, unnest(range(0, len(t), 50)) AS b FROM (SELECT doc_id, {TOKENS} AS t FROM documents))")
def token_blocks(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.token_blocks(F.col("text"), 50)).alias("block", "text"))
    return d.select("doc_id", long("block").alias("block"), "text")


PACK = rf"""
WITH RECURSIVE l AS (SELECT doc_id, i, line, len(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '')) AS n FROM ({LINES})),
w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, line, n FROM l WHERE n > 0),
p AS (SELECT doc_id, i, n, n AS total, 0::BIGINT AS grp FROM w WHERE i = 1
      UNION ALL SELECT w.doc_id, w.i, w.n, CASE WHEN p.total + w.n <= 60 THEN p.total + w.n ELSE w.n END, CASE WHEN p.total + w.n <= 60 THEN p.grp ELSE p.grp + 1 END FROM p JOIN w ON w.doc_id = p.doc_id AND w.i = p.i + 1)"""


def _packed(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n", -1), lambda x: X.count_tokens(x) > 0).alias("lines"))
    return d.withColumn("ids", chunk.pack_groups(F.transform("lines", X.count_tokens), 60))


@query(f"{PACK} SELECT doc_id, grp, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_tokens FROM p GROUP BY doc_id, grp")
def greedy_pack(spark, sf_dir):
    d = _packed(spark, sf_dir).select("doc_id", F.posexplode(chunk.grouped(F.col("lines"), F.col("ids"))).alias("grp", "g"))
    tokens = F.aggregate(F.transform("g", X.count_tokens), F.lit(0), lambda a, b: a + b)
    return d.select("doc_id", long("grp").alias("grp"), long(F.size("g")).alias("n_lines"), long(tokens).alias("n_tokens"))


@query(f"""{PACK}, c AS (SELECT doc_id, grp, count(*) AS k, sum(n) AS n, max_by(n, i) AS last_n FROM p GROUP BY doc_id, grp)
SELECT doc_id, grp, CAST(k + CASE WHEN n + lag(last_n) OVER (PARTITION BY doc_id ORDER BY grp) <= 60 THEN 1 ELSE 0 END AS BIGINT) AS n_pieces FROM c""")
def chunk_overlap(spark, sf_dir):
    d = _packed(spark, sf_dir).withColumn("chunks", chunk.grouped(F.col("lines"), F.col("ids")))
    d = d.select("doc_id", F.posexplode(chunk.overlapped(F.col("chunks"), 60)).alias("grp", "g"))
    return d.select("doc_id", long("grp").alias("grp"), long(F.size("g")).alias("n_pieces"))


def _articles(spark, sf_dir):
    """Documents as articles: the source is the law, the language its kind."""
    blank = F.lit("")
    return T(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("law_id"), F.col("source").alias("ten_van_ban"), F.col("lang").alias("loai_van_ban"), blank.alias("ngay_ban_hanh"), blank.alias("nganh"), blank.alias("linh_vuc"),
        blank.alias("phan"), blank.alias("chuong"), blank.alias("muc"), F.concat(F.lit("Điều "), F.col("doc_id").cast("string")).alias("dieu_so"), blank.alias("dieu_ten"), F.col("text").alias("noi_dung"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"),
        F.concat_ws("|", "source", "source", F.col("doc_id").cast("string")).alias("doc_uid"),
    )


_COUNT = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
_SENTENCES_OF = SENTENCES.replace("regexp_replace(text,", "regexp_replace(body,")


def _greedy(name: str, units: str, keys: str, weight: str) -> str:
    """Numbers the groups of units (keys, i from 1, weight): a group takes units while their sum stays within 128."""
    same = " AND ".join(f"u.{k} = p.{k}" for k in keys.split(", "))
    mine = ", ".join(f"u.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, i, {weight} AS total, 0::BIGINT AS grp FROM {units} WHERE i = 1
  UNION ALL SELECT {mine}, u.i, CASE WHEN p.total + u.{weight} <= 128 THEN p.total + u.{weight} ELSE u.{weight} END, p.grp + CASE WHEN p.total + u.{weight} <= 128 THEN 0 ELSE 1 END
  FROM {name} p JOIN {units} u ON {same} AND u.i = p.i + 1)"""


CHUNKS = rf"""
WITH RECURSIVE lines AS (SELECT doc_id, i, line, sum(CASE WHEN regexp_matches(line, '^\s*\d+\.\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS clause FROM ({LINES})),
bodies AS (SELECT doc_id, clause, {STRIP.format("string_agg(line, chr(10) ORDER BY i)")} AS body FROM lines GROUP BY doc_id, clause),
clauses AS (SELECT *, {_COUNT.format("body")} AS n FROM bodies WHERE body <> ''),
said AS (SELECT doc_id, clause, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, clause, {_SENTENCES_OF} AS s FROM clauses WHERE n > 128)),
sized AS (SELECT *, {_COUNT.format("s")} AS n, least({_COUNT.format("s")}, 129) AS w FROM said),
{_greedy("runs", "sized", "doc_id, clause", "w")},
units AS (SELECT doc_id, clause, 0 AS grp, 0 AS block, body AS piece FROM clauses WHERE n <= 128
  UNION ALL SELECT doc_id, clause, grp, 0, string_agg(s, chr(10) ORDER BY i) FROM runs JOIN sized USING (doc_id, clause, i) WHERE n <= 128 GROUP BY doc_id, clause, grp
  UNION ALL SELECT doc_id, clause, grp, b, array_to_string(list_slice(t, b + 1, b + 128), ' ') FROM (
    SELECT doc_id, clause, grp, t, unnest(range(0, len(t), 128)) AS b FROM (SELECT doc_id, clause, grp, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS t FROM runs JOIN sized USING (doc_id, clause, i) WHERE n > 128))),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY clause, grp, block) AS i, piece, {_COUNT.format("piece")} AS n FROM units),
{_greedy("packs", "pieces", "doc_id", "n")},
chunks AS (SELECT doc_id, grp, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS body, sum(n) AS n, max_by(piece, i) AS last, max_by(n, i) AS last_n FROM packs JOIN pieces USING (doc_id, i) GROUP BY doc_id, grp),
wide AS (SELECT doc_id, grp, CASE WHEN n + lag(last_n) OVER w <= 128 THEN lag(last) OVER w || chr(10) || chr(10) || body ELSE body END AS body FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY grp))
SELECT d.source || '|' || d.source || '|' || d.doc_id AS doc_uid, d.source || '|' || d.source || '|' || d.doc_id || '#' || grp AS chunk_id, CAST(grp AS INT) AS part_idx,
  d.lang || ' > ' || d.source || ' > Điều ' || d.doc_id AS breadcrumb, d.lang || ' > ' || d.source || ' > Điều ' || d.doc_id || chr(10) || body AS chunk_text FROM wide JOIN documents d USING (doc_id)"""


@query(CHUNKS)
def chunk_documents(spark, sf_dir):
    return chunk.chunk_articles(_articles(spark, sf_dir), 128).select("doc_uid", "chunk_id", "part_idx", "breadcrumb", "chunk_text")


@query("SELECT s_suppkey, concat_ws(' > ', r_name, n_name, CASE WHEN s_suppkey % 2 = 0 THEN s_name END, s_suppkey || CASE WHEN s_acctbal > 0 THEN '. ' || s_name ELSE '' END) AS crumb FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def breadcrumb(spark, sf_dir):
    s = T(spark, sf_dir, "supplier").join(T(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(T(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    level, title = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(" \t"), F.when(F.col("s_acctbal") > 0, F.col("s_name"))
    return s.select("s_suppkey", X.breadcrumb(F.col("r_name"), F.col("n_name"), [level], F.col("s_suppkey").cast("string"), title).alias("crumb"))


# --- enrichment ----------------------------------------------------------------------------------


def _log(spark, sf_dir):
    c = T(spark, sf_dir, "conversations")
    return c.select(F.when(F.col("conv_id") % 10 != 0, F.col("conv_id").cast("string")).otherwise("").alias("chunk_id"), F.col("role").alias("short"), F.array("role", F.md5("text")).alias("key"), F.col("turn").alias("seq"))


@query("SELECT CAST(conv_id AS VARCHAR) AS chunk_id, max_by(role, turn) AS short, max_by(role || ',' || md5(text), turn) AS key FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id")
def cache_last_wins(spark, sf_dir):
    return enrich.last_records(_log(spark, sf_dir)).select("chunk_id", "short", F.array_join("key", ",").alias("key"))


@query("SELECT CAST(conv_id AS VARCHAR) AS chunk_id, coalesce(max_by(role || '!', turn) FILTER (WHERE turn % 2 = 0), max_by(role, turn)) AS short, coalesce(max_by(md5(text), turn) FILTER (WHERE turn % 2 = 0), max_by(md5(text), turn)) AS said FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id")
def summary_log(spark, sf_dir):
    """Last records of a log on disk: lines of another program with broken ones among them, then one append for each even turn."""
    scratch = Scratch(spark, "log")
    path = f"{scratch.root}/log"
    c = T(spark, sf_dir, "conversations").select(F.when(F.col("conv_id") % 10 != 0, F.col("conv_id").cast("string")).otherwise("").alias("chunk_id"), F.col("role").alias("short"), F.array(F.md5("text")).alias("key"), "turn")
    line = F.to_json(F.struct("chunk_id", "short", "key"))
    foreign = c.select("turn", "chunk_id", F.explode(F.array(F.lit("{broken"), line, F.lit(" "))).alias("value"))
    foreign.repartitionByRange(4, "chunk_id").sortWithinPartitions("chunk_id", "turn").select("value").write.text(path)
    for turn in (r.turn for r in c.filter("turn % 2 = 0").select("turn").distinct().orderBy("turn").collect()):  # as many as a conversation has turns
        part = c.filter(F.col("turn") == turn).withColumn("short", F.concat("short", F.lit("!")))
        sinks.append_summaries(part, path, readers.next_seq(readers.read_summary_log(spark, path)))
    return enrich.last_records(readers.read_summary_log(spark, path)).select("chunk_id", "short", F.element_at("key", 1).alias("said"))


def _as_chunks(spark, sf_dir):
    return T(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"))


LAST = "SELECT CAST(conv_id AS VARCHAR) AS chunk_id, max_by(role, turn) AS short, max_by(md5(text), turn) AS said FROM conversations WHERE conv_id % 10 <> 0 GROUP BY conv_id"
ENRICHED = f"""
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, l.short, l.said, coalesce('[TÓM TẮT] ' || l.short || chr(10) || chr(10) || '[Ý CHÍNH]' || chr(10) || '• ' || l.short || chr(10) || '• ' || l.said || chr(10) || chr(10), '')
  || '[NỘI DUNG ĐẦY ĐỦ]' || chr(10) || text AS enriched_text FROM documents d LEFT JOIN ({LAST}) l ON CAST(d.doc_id AS VARCHAR) = l.chunk_id"""


@query(f"SELECT chunk_id, md5(enriched_text) AS enriched_md5 FROM ({ENRICHED})")
def enriched_text(spark, sf_dir):
    return enrich.enrich(_as_chunks(spark, sf_dir), enrich.last_records(_log(spark, sf_dir))).select("chunk_id", F.md5("enriched_text").alias("enriched_md5"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce({SENTENCES}[1], '') AS short FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT chunk_id FROM ({LAST}))")
def resume_enrichment(spark, sf_dir):
    """What a resumed run summarises: chunks that the log lacks, by their first sentence."""
    unlimited = lambda c: first_sentence_summary(c, most_chars=1 << 30)
    return enrich.summarise_pending(_as_chunks(spark, sf_dir), enrich.last_records(_log(spark, sf_dir)), unlimited).select("chunk_id", "short")


@query(f"SELECT count(*) AS n_chunks, round(avg(CASE WHEN short IS NOT NULL THEN 1 ELSE 0 END), 6) AS short_rate, round(avg(CASE WHEN short IS NOT NULL THEN 1 ELSE 0 END), 6) AS key_rate FROM ({ENRICHED})")
def enrichment_coverage(spark, sf_dir):
    c = enrich.coverage(enrich.enrich(_as_chunks(spark, sf_dir), enrich.last_records(_log(spark, sf_dir))))
    return c.select("n_chunks", F.round("short_rate", 6).alias("short_rate"), F.round("key_rate", 6).alias("key_rate"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS short, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'a,' || event_type ELSE event_type END AS key FROM events")
def json_extract(spark, sf_dir):
    """Replies with a list, with a bare string, within other words, and without the key field."""
    e, kind = T(spark, sf_dir, "events"), F.col("event_type")
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"short": "'), kind, F.lit('"}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('Sure: {"short": "'), kind, F.lit('", "key": ["a", "'), kind, F.lit('"]} done')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"key": ["'), kind, F.lit('"], "short": "'), kind, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"short": "'), kind, F.lit('", "key": "'), kind, F.lit('", "more": {"a": 1}}')))
    )
    r = e.select("event_id", X.summary_reply(reply).alias("r"))
    return r.select("event_id", F.col("r.short").alias("short"), F.when(F.col("r").isNotNull(), F.array_join("r.key", ",")).alias("key"))


# --- graph ---------------------------------------------------------------------------------------

CONCEPTS = ("thea", "Éau", "schö", "the with", "ción de")
MENTIONS = " UNION ALL ".join(f"SELECT doc_id, source, '{c.lower()}' AS concept FROM documents WHERE contains(lower(text), '{c.lower()}')" for c in CONCEPTS)


def _graph(spark, sf_dir):
    """Documents as articles of their sources; each source details the next."""
    d = T(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_uid"), F.col("source").alias("doc_id"), F.lit(0).alias("part_idx"), F.col("source").alias("law_id"), F.col("lang").alias("ten_van_ban"), F.concat(F.lit("Điều "), F.col("doc_id").cast("string")).alias("dieu_so"), F.lit("").alias("short"), F.col("text").alias("enriched_text"))
    docs = d.select("source").distinct().select(F.col("source").alias("id"), F.col("source").alias("law_id"), F.col("source").alias("ten_van_ban"), F.lit("law").alias("loai_van_ban"), F.lit("").alias("nganh"), F.lit("").alias("ngay_ban_hanh"))
    number = F.substring("id", 4, 9).cast("int")
    links = docs.select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), (number + 1).cast("string")).alias("other_doc_id"), F.when(number % 3 == 0, "details").when(number % 3 == 1, "amends").otherwise("other").alias("relationship"))
    return docs, chunks, links


LABELS = {"details": "DETAILS", "amends": "AMENDS"}
LINKS = "SELECT DISTINCT source AS a, 'src' || (CAST(substr(source, 4) AS INT) + 1) AS b, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'DETAILS' WHEN 1 THEN 'AMENDS' ELSE 'other' END AS rel FROM documents WHERE 'src' || (CAST(substr(source, 4) AS INT) + 1) IN (SELECT source FROM documents)"


@query(f"SELECT DISTINCT 'DOC:' || source AS node_id, 'Document' AS type FROM documents UNION ALL SELECT 'ART:' || doc_id, 'Article' FROM documents UNION ALL SELECT 'CONCEPT:' || c, 'Concept' FROM (VALUES {', '.join(f'({c.lower()!r})' for c in CONCEPTS)}) v(c)")
def graph_nodes(spark, sf_dir):
    docs, chunks, links = _graph(spark, sf_dir)
    return graph.build(docs, chunks, links, LABELS, CONCEPTS)[0].select("node_id", "type")


@query(f"SELECT 'DOC:' || source AS src, 'ART:' || doc_id AS dst, 'HAS_ARTICLE' AS rel FROM documents UNION ALL SELECT 'DOC:' || a, 'DOC:' || b, rel FROM ({LINKS}) UNION ALL SELECT 'ART:' || doc_id, 'CONCEPT:' || concept, 'MENTIONS' FROM ({MENTIONS})")
def graph_edges(spark, sf_dir):
    docs, chunks, links = _graph(spark, sf_dir)
    return graph.build(docs, chunks, links, LABELS, CONCEPTS)[1]


@query(f"SELECT doc_id, concept FROM ({MENTIONS})")
def concept_mentions(spark, sf_dir):
    return graph.mentions(T(spark, sf_dir, "documents"), "doc_id", "text", CONCEPTS)


@query("SELECT l_linestatus AS relationship, count(*) AS n_edges FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1")
def unmapped_labels(spark, sf_dir):
    return graph.unmapped_labels(T(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "relationship"), {"O": "OPEN"})


# --- retrieval -----------------------------------------------------------------------------------

_LOW = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
BM25 = f"""
tok AS (SELECT doc_id, unnest({_LOW}) AS term FROM documents), dl AS (SELECT doc_id, len({_LOW}) AS dl FROM documents),
tot AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
ask AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_LOW}) AS term FROM benchmark) GROUP BY ALL)"""


def _score(name: str, b: float) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))), 6) AS score FROM post JOIN ask USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), tot GROUP BY item_id, doc_id))"""


def _bm25(spark, sf_dir, k, *bs):
    """A ranking for each b, from one index."""
    index = lexical.build_index(T(spark, sf_dir, "documents"), "doc_id", "text")
    found = [lexical.search(index, T(spark, sf_dir, "benchmark"), "item_id", "text", k, b=b) for b in bs or (0.75,)]
    return found if bs else found[0]


@query(f"WITH {BM25}, {_score('hits', 0.75)} SELECT item_id, doc_id, score, rank FROM hits WHERE rank <= 50")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 50)


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.e, c.e), 6) AS score FROM u q, u c WHERE q.vec_id % 20 = 0)) WHERE rank <= 50""")
def dense_topk(spark, sf_dir):
    """Queries: every row whose id is divisible by 20, against all rows."""
    v = T(spark, sf_dir, "embeddings")
    return dense.search(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "vec_id", "embedding", "query_id", "q")


FUSED = "SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM a WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM b WHERE rank <= 50) GROUP BY item_id, doc_id"


def _fused(spark, sf_dir):
    return fuse.fuse(_bm25(spark, sf_dir, 50, 0.75, 0.0), "item_id", "doc_id")


@query(f"WITH {BM25}, {_score('a', 0.75)}, {_score('b', 0.0)} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({FUSED})) WHERE rank <= 30")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


EXPAND = f"""ment AS ({MENTIONS}), links AS ({LINKS}),
d AS (SELECT s.qid, x.doc_id, max(s.s) * 0.6 AS d FROM seeds s JOIN links l ON l.a = s.source AND l.rel IN ('DETAILS', 'AMENDS') JOIN documents x ON x.source = l.b GROUP BY ALL),
c AS (SELECT s.qid, o.doc_id, max(s.s) * 0.3 AS c FROM seeds s JOIN ment m ON m.doc_id = s.doc_id JOIN ment o ON o.concept = m.concept AND o.doc_id <> s.doc_id GROUP BY ALL),
m AS (SELECT qid, doc_id, max(s) AS s, max(d) AS d, max(c) AS c FROM (SELECT qid, doc_id, s, NULL AS d, NULL AS c FROM seeds UNION ALL SELECT qid, doc_id, NULL, d, NULL FROM d UNION ALL SELECT qid, doc_id, NULL, NULL, c FROM c) GROUP BY ALL),
r AS (SELECT qid, CAST(doc_id AS VARCHAR) AS chunk_id, round(CASE WHEN s IS NOT NULL THEN greatest(s, coalesce(d, s)) ELSE greatest(coalesce(d, c), coalesce(c, d)) END, 9) AS score FROM m),
wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 50)"""


@query(f"WITH {BM25}, {_score('a', 0.75)}, seeds AS (SELECT item_id AS qid, a.doc_id, score AS s, source FROM a JOIN documents USING (doc_id) WHERE rank <= 5), {EXPAND} SELECT * FROM wide")
def graph_expand(spark, sf_dir):
    docs, chunks, links = _graph(spark, sf_dir)
    edges = Scratch(spark, "graph").table(graph.build(docs, chunks, links, LABELS, CONCEPTS)[1])
    seeds = _bm25(spark, sf_dir, 5).select(F.col("item_id").alias("qid"), F.col("doc_id").cast("string").alias("chunk_id"), "score")
    return expand.expand(seeds, chunks, edges)


_OVERLAP = "len(list_intersect(list_distinct({q}), list_distinct({t})))::DOUBLE / len(list_distinct({q}))"
_SAME = _OVERLAP.format(q=_LOW.replace("lower(text)", "lower(q.text)"), t=_LOW.replace("lower(text)", "lower(substr(d.text, 1, 2000))"))


def _bins(name: str, key: str, text: str, table: str) -> str:
    """Unit vectors of word counts, one row for each place that isn't zero."""
    words = _LOW.replace("lower(text)", f"lower({text})")
    return f"""{name} AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS u FROM (
  SELECT {key}, bin, count(*)::DOUBLE AS c FROM (SELECT {key}, substr(md5(unnest({words})), 1, 2) AS bin FROM {table}) GROUP BY ALL))"""


def _dense_sql(name: str, held: str) -> str:
    return f"""{name} AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM (
  SELECT item_id, doc_id, round(sum(a.u * v.u), 6) AS score FROM asked a JOIN {held} v USING (bin) GROUP BY ALL))"""


@query(f"""
WITH {BM25}, {_score("a", 0.75).replace("score DESC, doc_id", "score DESC, CAST(doc_id AS VARCHAR)")},
{_bins("asked", "item_id", "text", "benchmark")}, {_bins("v_short", "doc_id", "substr(text, 1, 200)", "documents")}, {_bins("v_full", "doc_id", "text", "documents")},
{_dense_sql("near_short", "v_short")}, {_dense_sql("near_full", "v_full")},
fused AS (SELECT item_id AS qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT * FROM near_short UNION ALL SELECT * FROM near_full) WHERE rank <= 50 GROUP BY ALL),
seeds AS (SELECT qid, f.doc_id, s, source FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, CAST(doc_id AS VARCHAR)) AS place FROM fused) f JOIN documents USING (doc_id) WHERE place <= 30),
{EXPAND}, best AS (SELECT w.qid, w.chunk_id, round({_SAME}, 6) AS rerank_score FROM wide w JOIN benchmark q ON q.item_id = w.qid JOIN documents d ON CAST(d.doc_id AS VARCHAR) = w.chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, chunk_id) AS rank FROM best) WHERE rank <= 5""")
def hybrid_retrieve(spark, sf_dir):
    """BM25 and two dense searches, fusion, graph expansion and rerank. A text's first 200 characters are its summary."""
    docs, chunks, links = _graph(spark, sf_dir)
    edges = Scratch(spark, "graph").table(graph.build(docs, chunks, links, LABELS, CONCEPTS)[1])
    chunks = chunks.withColumn("short", F.substring("enriched_text", 1, 200)).withColumn("key", F.array().cast("array<string>"))
    questions = T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    # each search reads one vector, once: storing both would cost more than working them out
    return stages.retrieve(questions, chunks, edges, dense.build_vectors(chunks), stages.question_vectors(questions)).select("qid", "chunk_id", "rerank_score", "rank")


HITS = f"""hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, chunk_id) AS rank FROM (
  SELECT a.item_id AS qid, a.doc_id AS chunk_id, round({_SAME}, 6) AS rerank_score
  FROM a JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id) WHERE a.rank <= 10)),
top AS (SELECT h.qid, h.chunk_id, h.rank, h.rerank_score, d.text, d.source, d.lang, 'Điều ' || d.doc_id AS dieu_so FROM hits h JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 5)"""


def _hits(spark, sf_dir):
    """The five best of ten lexical hits of each benchmark item."""
    d = T(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("law_id"), F.col("lang").alias("ten_van_ban"), F.concat(F.lit("Điều "), F.col("doc_id").cast("string")).alias("dieu_so"))
    q = T(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    c = _bm25(spark, sf_dir, 10).select("item_id", "doc_id").join(d, "doc_id").join(q, "item_id")
    c = c.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.col("doc_id"), "question", "law_id", "ten_van_ban", "dieu_so", F.lit("").alias("dieu_ten"), F.lit("").alias("short"), F.col("text").alias("noi_dung"), F.col("text").alias("enriched_text"))
    return Scratch(spark, "hits").table(answer.rerank(c))


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS} SELECT qid, chunk_id, rerank_score, rank FROM top")
def rerank_lexical(spark, sf_dir):
    return _hits(spark, sf_dir).select("qid", "chunk_id", "rerank_score", "rank")


# --- answers -------------------------------------------------------------------------------------


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS} SELECT qid, string_agg('[' || rank || '] ' || lang || ' — ' || dieu_so || ': ' || chr(10) || 'Tóm tắt: ' || chr(10) || 'Nội dung: ' || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS contexts FROM top GROUP BY qid")
def context_block(spark, sf_dir):
    return answer.contexts(_hits(spark, sf_dir))


@query(f"""
WITH {BM25}, {_score('a', 0.75)}, {HITS}, links AS ({LINKS})
SELECT q.qid, coalesce(g, '{config.NO_RELATIONS}') AS graph_context FROM (SELECT DISTINCT qid FROM top) q LEFT JOIN (
  SELECT qid, string_agg(line, chr(10) ORDER BY line) AS g FROM (SELECT DISTINCT qid, '• ' || rel || ': ' || b AS line FROM top JOIN links ON a = source WHERE rel IN ('DETAILS', 'AMENDS', 'REPLACES')) GROUP BY qid) x ON x.qid = q.qid""")
def graph_context(spark, sf_dir):
    docs, chunks, links = _graph(spark, sf_dir)
    hits = _hits(spark, sf_dir).withColumn("doc_id", F.col("law_id"))
    names = graph.document_nodes(docs).select("node_id", F.col("attributes")["ten"].alias("name"))
    return answer.graph_contexts(hits, graph.relation_edges(links, docs, LABELS), names)


ANSWERED = "ans AS (SELECT qid, max(CASE WHEN rank = 1 THEN 'Theo ' || dieu_so || CASE WHEN qid % 3 = 0 THEN ' (13/2017/QH)' WHEN qid % 3 = 1 THEN ' tham khảo' ELSE repeat(' x', 150) END END) AS answer FROM top GROUP BY qid)"


def _answers(hits):
    tail = F.when(F.col("qid") % 3 == 0, " (13/2017/QH)").when(F.col("qid") % 3 == 1, " tham khảo").otherwise(" x" * 150)
    return hits.filter("rank = 1").select("qid", F.concat(F.lit("Theo "), "dieu_so", tail).alias("answer"))


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS}, {ANSWERED} SELECT qid, answer || coalesce(string_agg(CASE WHEN NOT contains(answer, dieu_so) THEN chr(10) || '(Căn cứ bổ sung: ' || dieu_so || ' của ' || lang || ')' END, '' ORDER BY rank), '') AS answer FROM ans JOIN top USING (qid) GROUP BY qid, answer")
def citation_augment(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return answer.add_citations(_answers(hits), hits).select("qid", "answer")


JUDGED = """judged AS (SELECT qid, answer, (SELECT bool_or(contains(answer, t.dieu_so)) FROM top t WHERE t.qid = ans.qid) AS v01,
  (SELECT coalesce(bool_and(coalesce(len(list_filter(k.laws, lambda law: starts_with(law, x.n))) > 0, false)), true) FROM (SELECT unnest(regexp_extract_all(answer, '\\d+/\\d{4}/[A-ZĐ-]+')) AS n) x, (SELECT list(DISTINCT source) AS laws FROM top t WHERE t.qid = ans.qid) k) AS v02,
  contains(answer, 'tham khảo') OR contains(answer, 'không thay thế') AS v03, length(answer) >= 200 AS v04 FROM ans)"""


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS}, {ANSWERED}, {JUDGED} SELECT qid, v01, v02, v03, v04, v01 AND v02 AND v04 AS passed, answer || CASE WHEN v03 THEN '' ELSE chr(10) || '{config.DISCLAIMER}' END AS answer FROM judged")
def guardrail_flags(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return answer.guardrails(_answers(hits), hits).select("qid", "v01", "v02", "v03", "v04", "passed", "answer")


FALLBACK = f"SELECT qid, '**Tổng hợp từ căn cứ pháp luật:**' || chr(10) || chr(10) || string_agg('- **' || dieu_so || ' của ' || lang || '**: ' || substr(text, 1, 200), chr(10) ORDER BY rank) || chr(10) || chr(10) || '*{config.DISCLAIMER}*' AS answer FROM top WHERE rank <= 3 GROUP BY qid"


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS} {FALLBACK}")
def extractive_fallback(spark, sf_dir):
    return answer.fallback_answers(_hits(spark, sf_dir))


RECORDS = f"""rec AS (SELECT b.item_id AS id, b.text AS question, f.answer, (SELECT list(x ORDER BY r) FROM (SELECT source || '|' || lang AS x, min(rank) AS r FROM top t WHERE t.qid = b.item_id GROUP BY 1)) AS docs,
  (SELECT list(source || '|' || lang || '|' || dieu_so ORDER BY rank) FROM top t WHERE t.qid = b.item_id) AS arts FROM benchmark b LEFT JOIN ({FALLBACK}) f ON f.qid = b.item_id)"""


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS}, {RECORDS} SELECT id, question, answer, coalesce(array_to_string(docs, ';'), '') AS relevant_docs, coalesce(array_to_string(arts, ';'), '') AS relevant_articles FROM rec")
def submission_records(spark, sf_dir):
    hits, q = _hits(spark, sf_dir), T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    r = stages.answer_stage(q, hits)
    return r.select("id", "question", "answer", F.array_join("relevant_docs", ";").alias("relevant_docs"), F.array_join("relevant_articles", ";").alias("relevant_articles"))


@query("""
WITH rec AS (SELECT item_id AS id, 'Điều 1' || CASE WHEN item_id % 5 = 4 THEN '' ELSE repeat(' x', 150) END AS answer, CASE item_id % 5 WHEN 0 THEN ['a'] WHEN 2 THEN ['a|b', 'a|b'] ELSE ['a|b'] END AS docs,
  CASE WHEN item_id % 5 = 1 THEN ['a|b|Art 9'] ELSE ['a|b|Điều 1'] END AS arts FROM benchmark WHERE item_id % 5 <> 3),
marks AS (SELECT id, answer, docs, arts, list_transform(arts, lambda x: string_split(x, '|')) AS cut FROM rec)
SELECT id, 'bad_doc' AS rule FROM marks WHERE len(list_filter(docs, lambda x: len(string_split(x, '|')) <> 2)) > 0
UNION ALL SELECT id, 'bad_article' FROM marks WHERE len(list_filter(cut, lambda x: len(x) <> 3 OR NOT starts_with(x[-1], 'Điều'))) > 0
UNION ALL SELECT id, 'repeated_item' FROM marks WHERE len(list_distinct(docs)) < len(docs) OR len(list_distinct(arts)) < len(arts)
UNION ALL SELECT id, 'short_answer' FROM marks WHERE length(answer) < 200
UNION ALL SELECT id, 'no_citation' FROM marks WHERE len(list_filter(cut, lambda x: contains(answer, x[-1]))) = 0
UNION ALL SELECT item_id, 'missing_record' FROM benchmark WHERE item_id NOT IN (SELECT id FROM rec)""")
def submission_violations(spark, sf_dir):
    """Records broken on purpose, one way for each remainder of the id."""
    b = T(spark, sf_dir, "benchmark")
    k, doc, art = F.col("item_id") % 5, F.lit("a|b"), F.lit("a|b|Điều 1")
    r = b.filter(k != 3).select(
        F.col("item_id").alias("id"), F.col("text").alias("question"), F.when(k == 4, "Điều 1").otherwise("Điều 1" + " x" * 150).alias("answer"),
        F.when(k == 0, F.array(F.lit("a"))).when(k == 2, F.array(doc, doc)).otherwise(F.array(doc)).alias("relevant_docs"), F.when(k == 1, F.array(F.lit("a|b|Art 9"))).otherwise(F.array(art)).alias("relevant_articles"),
    )
    return answer.violations(r, b.select(F.col("item_id").alias("id")))


PROMPT_GRAPH = f"""links AS ({LINKS}), gr AS (SELECT q.qid, coalesce(g, '{config.NO_RELATIONS}') AS graph_context FROM (SELECT DISTINCT qid FROM top) q LEFT JOIN (
  SELECT qid, string_agg(line, chr(10) ORDER BY line) AS g FROM (SELECT DISTINCT qid, '• ' || rel || ': ' || b AS line FROM top JOIN links ON a = source WHERE rel IN ('DETAILS', 'AMENDS', 'REPLACES')) GROUP BY qid) x ON x.qid = q.qid),
ctx AS (SELECT qid, count(*) AS k, string_agg('[' || rank || '] ' || lang || ' — ' || dieu_so || ': ' || chr(10) || 'Tóm tắt: ' || chr(10) || 'Nội dung: ' || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY rank) AS contexts FROM top GROUP BY qid)"""


def _with_graph(spark, sf_dir):
    docs, _, links = _graph(spark, sf_dir)
    hits = _hits(spark, sf_dir).withColumn("doc_id", F.col("law_id"))
    questions = T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return questions, hits, graph.relation_edges(links, docs, LABELS), graph.document_nodes(docs).select("node_id", F.col("attributes")["ten"].alias("name"))


_FILLED = "replace(replace(replace(replace('{0}', '{{K}}', CAST(k AS VARCHAR)), '{{question}}', q.text), '{{contexts}}', contexts), '{{graph_context}}', graph_context)"


@query(f"WITH {BM25}, {_score('a', 0.75)}, {HITS}, {PROMPT_GRAPH} SELECT qid, md5({_FILLED.format(config.ANSWER_PROMPT)}) AS prompt_md5, '{config.ANSWER_SYSTEM}' AS system FROM ctx JOIN gr USING (qid) JOIN benchmark q ON q.item_id = qid")
def answer_prompts(spark, sf_dir):
    return answer.prompts(*_with_graph(spark, sf_dir)).select("qid", F.md5("prompt").alias("prompt_md5"), "system")


@query(f"""
WITH {BM25}, {_score('a', 0.75)}, {HITS}, {PROMPT_GRAPH},
ans AS (SELECT qid, '1) ' || lang || ' — ' || dieu_so || ': ' || chr(10) || 'Tóm tắt: ' || chr(10) || 'Nội dung: ' || substr(text, 1, 1500) || chr(10) || '4) {config.DISCLAIMER}' AS answer FROM top WHERE rank = 1),
cited AS (SELECT qid, answer || coalesce(string_agg(CASE WHEN NOT contains(answer, dieu_so) THEN chr(10) || '(Căn cứ bổ sung: ' || dieu_so || ' của ' || lang || ')' END, '' ORDER BY rank), '') AS answer FROM ans JOIN top USING (qid) GROUP BY qid, answer),
fall AS ({FALLBACK})
SELECT b.item_id AS id, CASE WHEN length(c.answer) >= 200 THEN c.answer ELSE f.answer END AS answer FROM benchmark b LEFT JOIN cited c ON c.qid = b.item_id LEFT JOIN fall f ON f.qid = b.item_id""")
def generated_answers(spark, sf_dir):
    """Answers of a generator without a model, through prompts, citations, guardrails and fallback."""
    return stages.generate_stage(*_with_graph(spark, sf_dir)).select("id", "answer")


# --- evaluation ----------------------------------------------------------------------------------

_PRED = "SELECT o_custkey AS id, list(DISTINCT CAST(o_orderkey % 7 AS VARCHAR)) AS p, list(DISTINCT CAST(o_orderkey % 5 AS VARCHAR)) FILTER (WHERE o_orderstatus = 'F') AS g FROM orders GROUP BY o_custkey"
F2 = f"""s AS (SELECT id, CASE WHEN len(p) = 0 AND len(coalesce(g, [])) = 0 THEN [1.0, 1.0, 1.0] WHEN len(p) = 0 OR len(coalesce(g, [])) = 0 THEN [0.0, 0.0, 0.0]
  ELSE [len(list_intersect(p, g)) / len(p)::DOUBLE, len(list_intersect(p, g)) / len(g)::DOUBLE, 0.0] END AS v, len(p) > 0 AND len(coalesce(g, [])) > 0 AS real FROM ({_PRED})),
f AS (SELECT id, v[1]::DOUBLE AS precision, v[2]::DOUBLE AS recall, CASE WHEN NOT real THEN v[3] WHEN v[1] + v[2] = 0 THEN 0 ELSE 5 * v[1] * v[2] / (4 * v[1] + v[2]) END::DOUBLE AS f2 FROM s)"""


def _scored(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    p = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set((F.col("o_orderkey") % 7).cast("string")).alias("relevant_articles"))
    g = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 5).cast("string"))).alias("relevant_articles"))
    return evaluate.per_question(p, g)


@query(f"WITH {F2} SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f2, 6) AS f2 FROM f")
def f2_per_query(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")))


@query(f"WITH {F2} SELECT count(*) AS n_questions, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f2), 6) AS macro_f2 FROM f")
def f2_macro(spark, sf_dir):
    return evaluate.macro(_scored(spark, sf_dir))


@query(rf"""WITH {BM25}, {_score('a', 0.75)}, {HITS},
said AS (SELECT qid, 'Theo ' || CASE WHEN qid % 2 = 0 THEN dieu_so ELSE 'Điều 999999999' END || '.' AS answer FROM top WHERE rank = 1),
cites AS (SELECT qid, regexp_extract_all(lower(answer), 'điều\s+\d+[a-zđ]?') AS c, (SELECT list(lower(dieu_so)) FROM top t WHERE t.qid = said.qid) AS k FROM said)
SELECT count(*) AS n_answers, count(*) FILTER (WHERE len(c) > 0) AS n_cited, round(avg(CASE WHEN len(c) > 0 AND len(list_filter(c, lambda x: NOT list_contains(k, x))) = 0 THEN 1 ELSE 0 END), 6) AS grounding_rate FROM cites""")
def grounding_rate(spark, sf_dir):
    """Answers of odd questions cite an article that their hits lack."""
    hits = _hits(spark, sf_dir)
    q = T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    known = answer.submission(q, answer.fallback_answers(hits), hits).select("id", "relevant_articles")
    said = hits.filter("rank = 1").select(F.col("qid").alias("id"), F.concat(F.lit("Theo "), F.when(F.col("qid") % 2 == 0, F.col("dieu_so")).otherwise("Điều 999999999"), F.lit(".")).alias("answer"))
    return evaluate.grounding(said, known)


@query("SELECT source, lang, n, rank FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) WHERE rank <= 2")
def top_k_per_key(spark, sf_dir):
    n = T(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return dedup.top_k(n, ["source"], [F.col("n").desc(), F.col("lang").asc()], 2)


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(turn, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def neighbour_rows(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("turn", 1, -1).over(w).alias("next_turn"))
