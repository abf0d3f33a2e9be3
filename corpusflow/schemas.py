"""Explicit schemas of the tables that stages exchange."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def _schema(columns: str) -> T.StructType:
    """From 'name type, ...'; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


_METADATA = "title so_ky_hieu ngay_ban_hanh loai_van_ban ngay_co_hieu_luc ngay_het_hieu_luc nguon_thu_thap ngay_dang_cong_bao nganh linh_vuc co_quan_ban_hanh chuc_danh nguoi_ky pham_vi thong_tin_ap_dung tinh_trang_hieu_luc"
METADATA = _schema("id long, " + ", ".join(f"{c} string" for c in _METADATA.split()))
CONTENT = _schema("id long, content_html string")
RELATIONSHIPS = _schema("doc_id long, other_doc_id string, relationship string")
_ARTICLE = "doc_id string, law_id string, ten_van_ban string, loai_van_ban string, ngay_ban_hanh string, nganh string, linh_vuc string, phan string, chuong string, muc string, dieu_so string, dieu_ten string, noi_dung string, start_char int, end_char int, doc_uid string"
ARTICLES = _schema(_ARTICLE)
FAILURES = _schema("doc_id string, title string, num_dieu int, reason string, text_preview string")
_CHUNK = _ARTICLE + ", breadcrumb string, chunk_id string, part_idx int, chunk_text string"
CHUNKS = _schema(_CHUNK)
#: ``seq`` numbers the appends; the last record of a chunk counts.
SUMMARY_LOG = _schema("chunk_id string, short string, key array<string>, seq long")
ENRICHED = _schema(_CHUNK + ", short string, key array<string>, enriched_text string")
NODES = _schema("node_id string, type string, attributes map<string,string>")
EDGES = _schema("src string, dst string, rel string")
QUESTIONS = _schema("id long, question string")
RESULTS = _schema("id long, question string, answer string, relevant_docs array<string>, relevant_articles array<string>")
