"""Stages on hand-written legal fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusflow import config, schemas
from corpusflow.operators import answer, chunk, dedup, diagnose, enrich, evaluate, expand, gates, graph, scope, segment
from corpusflow.plans import stages
from corpusflow.sources import readers, sinks
from corpusflow.streaming import enrichment

LONG = "Nội dung đủ dài để được giữ lại trong bảng điều."


def metadata(spark, rows):
    base = {f.name: None for f in schemas.METADATA} | {"tinh_trang_hieu_luc": "Còn hiệu lực", "loai_van_ban": "Luật"}
    return spark.createDataFrame([tuple((base | r)[f.name] for f in schemas.METADATA) for r in rows], schemas.METADATA)


def test_scope(spark):
    rows = [
        dict(id=1, title="Luật DOANH NGHIỆP", so_ky_hieu="1"), dict(id=2, title="x", so_ky_hieu="2", linh_vuc="Bảo hiểm"), dict(id=3, title="x", so_ky_hieu="3", nganh="Lao động"), dict(id=4, title="x", so_ky_hieu="4"),
        dict(id=5, title="thuế", so_ky_hieu="5", tinh_trang_hieu_luc="Hết hiệu lực toàn bộ"), dict(id=6, title="thuế", so_ky_hieu="6", loai_van_ban=None), dict(id=7, title="thuế", so_ky_hieu="7", loai_van_ban="Khác"),
        dict(id=8, title="thuế", so_ky_hieu="8"), dict(id=9, title="thuế a", so_ky_hieu="9"), dict(id=10, title="thuế a", so_ky_hieu="9"), dict(id=11, so_ky_hieu="11", linh_vuc="Đầu tư"),
    ]
    content = spark.createDataFrame([(str(i),) for i in range(1, 12) if i != 8], "id string")
    out = scope.scope_filter(metadata(spark, rows), content)
    assert {r.id: r.ten_van_ban for r in out.collect()} == {1: "Luật 1 Luật DOANH NGHIỆP", 2: "Luật 2 x", 3: "Luật 3 x", 6: "None 6 thuế", 9: "Luật 9 thuế a", 11: "Luật 11"}
    with pytest.raises(gates.GateError):
        scope.scope_filter(metadata(spark, rows), content, check=True)


def parsed(spark, docs):
    meta = metadata(spark, [dict(id=i, title=t, so_ky_hieu=str(i)) for i, t, _ in docs]).withColumn("law_id", F.col("so_ky_hieu")).withColumn("ten_van_ban", F.col("title"))
    content = spark.createDataFrame([(i, h) for i, _, h in docs], schemas.CONTENT)
    return stages.parse_documents(meta, content)


def test_policy(spark):
    docs = [
        (1, "Luật A", "ngắn"), (2, "Luật A", f"<p>{LONG}</p>"), (3, "Thông báo", f"<p>{LONG}</p>"), (4, "Luật A", "Điều 1. a"), (5, "Luật A", "<p>Điều 1. Tên rất dài của điều này là như vậy</p><p>ngắn</p>"),
        (6, "Thông báo", "<p>Điều 1. Tên rất dài của điều này là như vậy</p><p>ngắn</p>"), (7, "Luật A", f"<p>Điều 1. Tên</p><p>{LONG}</p><p>Điều 2. x</p><p>ngắn</p>"), (8, "Luật A", f"<p>Điều 1. Tên</p><p>{LONG}</p><p>Điều 2. Khác</p><p>{LONG}</p>"), (9, "Luật A", None),
    ]
    got = {r.id: (len(r.records), r.reason, r.num_dieu) for r in parsed(spark, docs).collect()}
    short = "text_too_short_after_cleaning"
    assert got == {1: (0, short, 0), 2: (1, "zero_dieu_law_like_doc", 0), 3: (1, None, 0), 4: (0, short, 0), 5: (0, "zero_parsable_dieu_law_like_doc", 1), 6: (1, None, 0), 7: (1, "single_dieu_law_like_doc", 1), 8: (2, None, 0), 9: (0, short, 0)}


def test_segmentation_keeps_hierarchy(spark, tmp_path):
    text = f"Chương I\nMục 1 Chung\nĐiều 5. Tên\n{LONG}\nChương II\nĐiều 5. Tên khác\n{LONG} và phần này còn dài hơn\nĐiều 6a. Cuối\n{LONG}"
    content = spark.createDataFrame([(1, text.replace("\n", "<br>"))], schemas.CONTENT)
    meta = metadata(spark, [dict(id=1, title="Thông báo", so_ky_hieu="1")]).withColumn("law_id", F.lit("1")).withColumn("ten_van_ban", F.lit("N"))
    articles, failures = stages.parse_stage(meta, content, str(tmp_path))
    rows = {r.dieu_so: r for r in articles.collect()}
    assert set(rows) == {"Điều 5", "Điều 6a"} and failures.count() == 0
    assert rows["Điều 5"].noi_dung.endswith("dài hơn") and rows["Điều 5"].chuong == "Chương II" and rows["Điều 5"].muc == "Mục 1 Chung"
    assert rows["Điều 5"].doc_uid == "1|N|Điều 5" and rows["Điều 6a"].end_char == len(text)


def article(uid, body, **more):
    base = {f.name: "" for f in schemas.ARTICLES} | dict(start_char=0, end_char=len(body), doc_uid=uid, noi_dung=body, loai_van_ban="Luật", ten_van_ban="N", dieu_so="Điều 1") | more
    return tuple(base[f.name] for f in schemas.ARTICLES)


def reference_chunks(body, most):
    import re

    count = lambda t: len(t.split())
    pieces = []
    for p in [x.strip() for x in re.split(r"(?m)(?=^\s*\d+\.\s)", body.strip()) if x.strip()]:
        if count(p) <= most:
            pieces.append(p)
            continue
        held = []
        for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", p) if x.strip()]:
            if count(s) > most or (held and sum(map(count, held)) + count(s) > most):
                if held:
                    pieces.append("\n".join(held))
                held = []
            if count(s) > most:
                w = s.split()
                pieces += [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
            else:
                held.append(s)
        if held:
            pieces.append("\n".join(held))
    groups = []
    for p in pieces:
        if groups and sum(map(count, groups[-1])) + count(p) <= most:
            groups[-1].append(p)
        else:
            groups.append([p])
    wide = [([groups[i - 1][-1], *g] if i and count("\n\n".join([groups[i - 1][-1], *g])) <= most else g) for i, g in enumerate(groups)]
    return ["\n\n".join(g) for g in wide]


def test_chunks_like_a_plain_loop(spark):
    rng = random.Random(3)
    bodies = ["", "một hai", "1. a b c\n2. d e f", "a b c d e f g h i j k l m"]
    for _ in range(40):
        bodies.append("".join(rng.choice(["1. ", "2. ", ""]) + " ".join(rng.choice(["x", "yy.", "z!", "w"]) for _ in range(rng.randrange(1, 30))) + rng.choice(["\n", ". ", "\n\n"]) for _ in range(rng.randrange(1, 6))))
    df = spark.createDataFrame([article(f"u{i}", b) for i, b in enumerate(bodies)], schemas.ARTICLES)
    got = {}
    for r in chunk.chunk_articles(df, 10).orderBy("part_idx").collect():
        head, _, body = r.chunk_text.partition("\n")
        assert head == r.breadcrumb == "Luật > N > Điều 1" and r.chunk_id == f"{r.doc_uid}#{r.part_idx}"
        got.setdefault(r.doc_uid, []).append(body)
    assert got == {f"u{i}": c for i, b in enumerate(bodies) if (c := reference_chunks(b, 10))}


def test_blank_uid_is_an_error(spark):
    with pytest.raises(Exception, match="doc_uid"):
        chunk.chunk_articles(spark.createDataFrame([article(" ", "a")], schemas.ARTICLES)).collect()


def chunks(spark, n):
    return spark.createDataFrame([(f"c{i}", f"Câu {i}. Thêm.") for i in range(n)], "chunk_id string, chunk_text string")


def test_resumed_enrichment_equals_one_run(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    whole = stages.enrich_stage(chunks(spark, 6), one)
    stages.enrich_stage(chunks(spark, 3), two)
    resumed = stages.enrich_stage(chunks(spark, 6), two)
    assert sorted(map(str, whole.collect())) == sorted(map(str, resumed.collect())) and resumed.count() == 6
    assert readers.read_summary_log(spark, two).count() == 6
    assert enrich.coverage(whole).first().short_rate == 1.0


def test_log_survives_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"chunk_id": "a", "short": "1", "key": []}\n\nnot json\n{"chunk_id": "", "short": "x"}\n{"chunk_id": "a", "short": "2", "key": ["k"]}\n', encoding="utf-8")
    rows = enrich.last_records(readers.read_summary_log(spark, str(tmp_path / "log.jsonl"))).collect()
    assert [(r.chunk_id, r.short, r.key) for r in rows] == [("a", "2", ["k"])]


def test_the_last_append_wins_over_foreign_logs(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda c, s: json.dumps({"chunk_id": c, "short": s, "key": []}) + "\n"
    (log / "a.json").write_text(line("x", "1") + line("y", "1") + line("z", "1"), encoding="utf-8")
    (log / "b.json").write_text(line("y", "2") + line("x", "2") + line("x", "3"), encoding="utf-8")
    read = lambda: {r.chunk_id: r.short for r in enrich.last_records(readers.read_summary_log(spark, str(log))).collect()}
    assert read() == {"x": "3", "y": "2", "z": "1"}
    for short in ("4", "5"):  # appends count after all lines before them, however soon they follow each other
        new = spark.createDataFrame([("x", short, [])], "chunk_id string, short string, key array<string>")
        sinks.append_summaries(new, str(log), readers.next_seq(readers.read_summary_log(spark, str(log))))
        assert read() == {"x": short, "y": "2", "z": "1"}


def test_the_first_body_of_an_id_counts(spark, tmp_path):
    rows = [(1, "<p>law</p>"), (1, ""), (1, None), (2, ""), (2, "b"), (2, "c"), (3, None), (4, "a")]
    spark.createDataFrame(rows, schemas.CONTENT).coalesce(1).write.parquet(str(tmp_path / "c"))
    for content in (spark.createDataFrame(rows, schemas.CONTENT), spark.read.parquet(str(tmp_path / "c"))):
        assert {r.id: r.html for r in readers.content_of(content).collect()} == {"1": "<p>law</p>", "2": "b", "3": "", "4": "a"}
        some = readers.content_of(content, spark.createDataFrame([("2",), ("9",), ("2",)], "id string"))
        assert [tuple(r) for r in some.collect()] == [("2", "b")]


def test_stream_summarises_each_chunk_once(spark, tmp_path):
    empty = {f.name: "" for f in schemas.CHUNKS} | dict(start_char=0, end_char=0, part_idx=0)
    row = lambda i: tuple((empty | dict(chunk_id=f"c{i}", chunk_text=f"Câu {i}."))[f.name] for f in schemas.CHUNKS)
    source, log, check = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check")
    for ids in ((0, 1), (1, 2)):
        spark.createDataFrame([row(i) for i in ids], schemas.CHUNKS).coalesce(1).write.mode("append").parquet(source)
        enrichment.start(spark, source, log, check).awaitTermination(120)
    assert sorted(r.chunk_id for r in readers.read_summary_log(spark, log).collect()) == ["c0", "c1", "c2"]


def sequential_expand(seeds, chunk_rows, edges, p):
    """The walk over a graph, one seed after another, by descending score."""
    uid = {c: u for c, u, _ in chunk_rows}
    first = {u: c for c, u, k in chunk_rows if k == 0}
    out = dict(seeds)
    for c, s in sorted(seeds.items(), key=lambda x: -x[1]):
        art = f"ART:{uid[c]}"
        doc = next((a for a, b, r in edges if b == art and r == "HAS_ARTICLE"), None)
        if doc is None:
            continue
        for near in {b for a, b, r in edges if a == doc and r in config.TRAVERSED_RELATIONS}:
            for b in {b for a, b, r in edges if a == near and b.startswith("ART:")}:
                if b[4:] in first:
                    out[first[b[4:]]] = max(out.get(first[b[4:]], 0.0), s * p.discount_doc)
        for concept in {b for a, b, r in edges if a == art and b.startswith("CONCEPT:")}:
            for a in {a for a, b, r in edges if b == concept}:
                if a != art and a[4:] in first and first[a[4:]] not in out:
                    out[first[a[4:]]] = s * p.discount_concept
    return out


def test_expansion_equals_the_walk(spark):
    rng, p = random.Random(11), config.Retrieval(expanded_top=1000)
    all_seeds, all_chunks, all_edges, want = [], [], [], {}
    for q in range(30):
        arts = [f"{q}a{i}" for i in range(6)]
        rows = [(f"{a}#{k}", a, k) for a in arts for k in range(rng.choice([1, 1, 2]))]
        edges = [(f"DOC:{q}d{i % 3}", f"ART:{a}", "HAS_ARTICLE") for i, a in enumerate(arts)]
        edges += [(f"DOC:{q}d{rng.randrange(3)}", f"DOC:{q}d{rng.randrange(3)}", rng.choice(["DETAILS", "AMENDS", "CORRECTS"])) for _ in range(3)]
        edges += [(f"ART:{rng.choice(arts)}", f"CONCEPT:{q}c{rng.randrange(2)}", "MENTIONS") for _ in range(6)]
        seeds = {c: s for c, s in zip(rng.sample([r[0] for r in rows], 3), rng.sample([0.9, 0.7, 0.5, 0.3, 0.2], 3))}
        all_seeds += [(q, c, s) for c, s in seeds.items()]
        all_chunks += rows
        all_edges += edges
        want |= {(q, c): round(s, 9) for c, s in sequential_expand(seeds, rows, edges, p).items()}
    got = expand.expand(spark.createDataFrame(all_seeds, "qid int, chunk_id string, score double"), spark.createDataFrame(all_chunks, "chunk_id string, doc_uid string, part_idx int"), spark.createDataFrame(all_edges, "src string, dst string, rel string"), params=p)
    assert {(r.qid, r.chunk_id): r.score for r in got.collect()} == want


def test_graph_keeps_unknown_labels(spark):
    docs = spark.createDataFrame([("1", "1", "N", "Luật", "", "")], "id string, law_id string, ten_van_ban string, loai_van_ban string, nganh string, ngay_ban_hanh string")
    rel = spark.createDataFrame([(1, "1", "Văn bản thay thế"), (1, "1", "lạ"), (1, "9", "lạ")], schemas.RELATIONSHIPS)
    assert sorted(r.rel for r in graph.relation_edges(rel, docs).collect()) == ["REPLACES", "lạ"]
    assert [tuple(r) for r in graph.unmapped_labels(rel).collect()] == [("lạ", 2)]


def hits(spark):
    return spark.createDataFrame([(1, 1, "a", "13/2017/QH14", "Luật N", "Điều 1", "T", "", "thân bài"), (1, 2, "b", "2/2020/NĐ-CP", "Nghị định M", "Điều 2", "U", "tóm", "thân")], "qid long, rank long, chunk_id string, law_id string, ten_van_ban string, dieu_so string, dieu_ten string, short string, noi_dung string")


def test_answers(spark):
    said = spark.createDataFrame([(1, "Theo Điều 13 của 13/2017/QH14. " + "x " * 120)], "qid long, answer string")
    judged = answer.guardrails(answer.add_citations(said, hits(spark)), hits(spark)).first()
    assert judged.answer.count("Căn cứ bổ sung") == 1 and judged.v01 and judged.v02 and not judged.v03 and judged.answer.endswith(config.DISCLAIMER)
    strict = answer.guardrails(said, hits(spark), strict_numbers=True, strict_citations=True).first()
    assert not strict.v01 and not strict.v02 and "V02_no_fabricated_law_id" in strict.reasons
    spare = answer.answered(said, hits(spark), strict_numbers=True).first().answer
    assert spare.startswith("**Tổng hợp") and "- **Điều 1 của Luật N**: thân bài\n- **Điều 2 của Nghị định M**: tóm" in spare


def test_submission(spark, tmp_path):
    q = spark.createDataFrame([(1, "hỏi"), (2, "khác")], schemas.QUESTIONS)
    r = stages.answer_stage(q, hits(spark))
    assert r.filter("id = 1").first().relevant_articles == ["13/2017/QH14|Luật N|Điều 1", "2/2020/NĐ-CP|Nghị định M|Điều 2"]
    broken = {(v.id, v.rule) for v in answer.violations(r.filter("id = 1"), q).collect()}
    assert broken == {(1, "short_answer"), (2, "missing_record")}
    sinks.write_submission(r.filter("id = 1"), str(tmp_path))
    assert json.loads((tmp_path / "results.json").read_text(encoding="utf-8"))[0]["id"] == 1


def test_evaluation(spark):
    s = "id long, relevant_articles array<string>"
    gold = spark.createDataFrame([(1, []), (2, ["a"]), (3, []), (4, ["a", "b"]), (5, ["a", "b", "b"])], s)
    pred = spark.createDataFrame([(1, []), (2, []), (3, ["x"]), (4, ["c"]), (5, ["a", "a", "c"])], s)
    got = {r.id: (r.precision, r.recall, r.f2) for r in evaluate.per_question(pred, gold).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0.5, 0.5, 0.5)}
    assert evaluate.macro(evaluate.per_question(pred, gold)).first().macro_f2 == 0.3


def test_dedup_and_gates(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "xyz"), (3, None, "p"), (4, None, "q")], "i int, k string, t string")
    assert sorted(r.i for r in dedup.keep_first(df, ["k"], ["i"]).collect()) == [1, 3]
    assert sorted(r.i for r in dedup.keep_longest(df, ["k"], "t", ["i"]).collect()) == [2, 3]
    fixes = spark.createDataFrame([(9, "a")], "i int, k string")
    assert sorted(r.i for r in dedup.override_last(df, fixes, ["k"], ["i"]).collect()) == [4, 9]
    with pytest.raises(gates.GateError):
        gates.require_unique(df, ["k"])
    gates.require_unique(df, ["i"])
    with pytest.raises(gates.GateError):
        gates.require_contained(df, df.filter("i > 1"), "i")


def test_sources(spark, tmp_path):
    (tmp_path / "content.jsonl").write_text('{"id": 1, "content_html": "", "content": "c"}\n{"id": 1, "content_html": "", "content": "c"}\n', encoding="utf-8")
    path = readers.discover(spark, str(tmp_path))
    assert path.endswith("content.jsonl") and readers.read_ids(spark, path).count() == 2
    assert [tuple(r) for r in readers.content_of(readers.read_table(spark, path)).collect()] == [("1", "c")]
    (tmp_path / "fix.json").write_text('{"doc_uid": "u", "noi_dung": "x"}', encoding="utf-8")
    assert readers.read_fixes(spark, str(tmp_path / "fix.json")).first().doc_uid == "u"
    assert readers.read_fixes(spark, str(tmp_path / "none.json")).count() == 0
    assert not sinks.write_failures(spark.createDataFrame([], schemas.FAILURES), str(tmp_path / "f"))
    with pytest.raises(FileNotFoundError):
        readers.discover(spark, str(tmp_path / "nowhere"))


def test_diagnosis(spark):
    failures = spark.createDataFrame([("1", "t", 0, "r", "p"), ("2", "t", 0, "s", "p")], schemas.FAILURES)
    content = spark.createDataFrame([(1, f"Điều 1. Tên\n{LONG}"), (2, "một\n\nhai")], schemas.CONTENT)
    arts = spark.createDataFrame([("1",)], "doc_id string")
    got = {r.doc_id: (r.n_headings, r.outline, r.in_articles) for r in diagnose.inspect(failures, content, arts, segment.Patterns().heading).collect()}
    assert got == {"1": (1, ["1 Tên"], True), "2": (0, ["một", "hai"], False)}
    assert diagnose.summary(failures).first().by_reason == {"r": 1, "s": 1}


def test_settings(tmp_path, monkeypatch):
    from corpusflow.sources import settings

    (tmp_path / "c.yaml").write_text("SME_NGANH:\n  - Một\nVALID_DOCUMENT_TYPES:\n  - Luật\n  - None\n", encoding="utf-8")
    s = settings.read_scope(str(tmp_path / "c.yaml"))
    assert s.sectors == ("Một",) and s.document_types == ("Luật", "None") and s.fields == config.FIELDS
    (tmp_path / ".env").write_text("# no\nA_NEW_ONE='x=y'\nHOME=/nowhere\n\nbad line\n", encoding="utf-8")
    monkeypatch.delenv("A_NEW_ONE", raising=False)
    assert settings.load_environment(str(tmp_path / ".env")) == {"A_NEW_ONE": "x=y"} and settings.load_environment(str(tmp_path / "none")) == {}
    monkeypatch.delenv("A_NEW_ONE")


def test_index_is_saved_and_loaded(spark, tmp_path):
    from corpusflow.operators import lexical

    docs = spark.createDataFrame([("a", "một hai"), ("b", "hai ba ba"), ("c", "bốn"), ("d", "năm")], "k string, t string")
    q = spark.createDataFrame([(1, "ba hai")], "id int, q string")
    one = lexical.build_index(docs, "k", "t")
    lexical.save(one, str(tmp_path))
    want = lexical.search(one, q, "id", "q").collect()
    assert lexical.search(lexical.load(spark, str(tmp_path)), q, "id", "q").collect() == want and want[0].k == "b"


def test_pruned_search_equals_the_whole(spark):
    from corpusflow.operators import lexical

    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(300)], weights, k=n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 60))) for i in range(800)] + [(900, None)], "k long, t string")
    q = spark.createDataFrame([(i, text(rng.randrange(0, 25))) for i in range(40)] + [(99, None)], "id int, q string")
    index = lexical.build_index(docs, "k", "t")
    found = [sorted(map(tuple, lexical.search(index, q, "id", "q", 3, prune_from=p).collect())) for p in (0, 10**12)]
    assert found[0] == found[1] and len(found[0]) > 100
    lexical_few, lexical.MOST_TERMS = lexical.MOST_TERMS, 0  # terms too many to broadcast
    try:
        assert sorted(map(tuple, lexical.search(index, q, "id", "q", 3).collect())) == found[1]
    finally:
        lexical.MOST_TERMS = lexical_few


def test_stages_from_a_shell(spark, tmp_path, monkeypatch):
    from corpusflow import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    at = lambda name: str(tmp_path / name)
    body = "<br>".join(f"Điều {i}. Thuế<br>{LONG} số {i}" for i in range(1, 4))
    metadata(spark, [dict(id=i, title="Luật thuế", so_ky_hieu=f"{i}/2020/QH14") for i in (1, 2)]).write.parquet(at("meta"))
    spark.createDataFrame([(i, body) for i in (1, 2)], schemas.CONTENT).write.parquet(at("content.parquet"))
    spark.createDataFrame([(1, "2", "Văn bản hướng dẫn")], schemas.RELATIONSHIPS).write.parquet(at("rel"))
    (tmp_path / "q.jsonl").write_text('{"id": 1, "question": "thuế số 2"}\n', encoding="utf-8")
    (tmp_path / "gold.json").write_text('[{"id": 1, "relevant_articles": ["x"]}]', encoding="utf-8")
    for line in (
        f"scope --metadata {at('meta')} --content {at('content.parquet')} --output {at('scoped')} --no-gates", f"parse --scoped {at('scoped')} --folder {at('')} --output {at('run')}", f"chunk --articles {at('run/articles')} --output {at('chunks')}",
        f"summarise --chunks {at('chunks')} --log {at('log')} --output {at('enriched')}", f"graph --scoped {at('scoped')} --enriched {at('enriched')} --relationships {at('rel')} --output {at('graph')}",
        f"answer --questions {at('q.jsonl')} --enriched {at('enriched')} --graph {at('graph')} --output {at('out')}", f"score --results {at('out/results.json')} --gold {at('gold.json')}",
    ):
        cli.main(line.split())
    got = json.loads((tmp_path / "out" / "results.json").read_text(encoding="utf-8"))
    assert len(got) == 1 and len(got[0]["relevant_articles"]) == 5 and spark.read.parquet(at("enriched")).count() == 6
