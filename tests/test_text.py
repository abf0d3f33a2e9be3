"""Column functions against small Python functions on made-up text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow import config
from corpusflow.functions import html, vectors
from corpusflow.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    return [r[0] for r in df.select(f(F.col("c")).alias("r"), "i").orderBy("i").collect()]


def test_strip_takes_unicode_spaces(spark):
    values = ["  a b\t\n", "", " ", "x", None]
    assert column(spark, values, X.strip) == ["a b", "", "", "x", None]


def test_lines(spark):
    values = ["a  b\t c\n\n\nd\nd\nd\ne\nd", "", "x\n \nx", "  "]
    assert column(spark, values, X.clean_text) == ["a b c\nd\ne\nd", "", "x\n \nx", "  "]


def random_text(rng):
    parts = ["Điều 5. Phạm vi", "ĐIỀU 6", "điều 7a: Tên", "Điều", "5.", "\n", "\n\n", " ", "\r\n", "Điều 13đ — Nợ", "chữ thường", "Chương II", "Mục đích chung", "Phần thứ nhất", " ", "😀", "Điều 9)\nNội dung"]
    return "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(rng.randrange(1, 25)))


@pytest.mark.parametrize("pattern, groups", [(config.HEADING_PATTERN, 3), *((p, 1) for p in config.HEADER_PATTERNS.values())])
def test_mark_and_split_finds_what_finditer_finds(spark, pattern, groups):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(120)] + ["", "no match"]
    found = column(spark, texts, lambda c: X.mark_and_split(c, pattern, groups))
    for text, got in zip(texts, found):
        matches = list(re.finditer(pattern, text, re.M | re.I))
        ends = [m.start() for m in matches[1:]] + [len(text)]
        want = [(m.start(), m.end(), [g or "" for g in m.groups()], text[m.end() : e]) for m, e in zip(matches, ends)]
        assert [(x.start, x.stop, x.groups, x.body) for x in got] == want, text


def test_titles(spark):
    rows = [
        ("Luật 04/2017/QH14 Hỗ trợ", "Luật", "04/2017/QH14", "Hỗ trợ"), ("LUẬT số 04/2017/QH14 - Hỗ trợ", "Luật", "04/2017/QH14", "Hỗ trợ"), ("– Về thuế", "Luật", "1", "Về thuế"), (":: Về thuế", "Luật", "1", ": Về thuế"),
        (" Luật 1 Về thuế", "Luật", "1", "Luật 1 Về thuế"), ("Luật 1+1/2020 Về", "Luật", "1+1/2020", "Về"), (None, "Luật", "1", ""), ("Nghị định X", None, None, "Nghị định X"), ("a\\Eb 1 x", "a\\Eb", "1", "x"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, k string, n string, want string")
    got = df.select(X.clean_title(F.col("t"), F.col("k"), F.col("n")).alias("g"), "want", X.full_name(F.col("k"), F.col("n"), F.col("t")).alias("f"), "i").orderBy("i").collect()
    assert [r.g for r in got] == [r.want for r in got]
    assert got[0].f == "Luật 04/2017/QH14 Hỗ trợ" and got[7].f == "None None Nghị định X"


def test_pieces(spark):
    assert column(spark, ["1. a b\n2. c\nd", "plain", " ", "x\n 3. y"], X.clauses) == [["1. a b", "2. c\nd"], ["plain"], [], ["x", "3. y"]]
    assert column(spark, ["One. Two! Three? Four", "no end", ""], X.sentences) == [["One.", "Two!", "Three?", "Four"], ["no end"], []]
    assert column(spark, ["a b c d e", "", None], lambda c: X.token_blocks(c, 2)) == [["a b", "c d", "e"], [], []]


def test_replies(spark):
    values = ['{"short": "s", "key": ["a", "b"]}', 'well: {"short": "s", "key": ["a"]} ok', '{"short": "s", "key": "one"}', '{"short": "s"}', "nothing", '{"key": ["x"], "short": "s", "more": {"a": 1}}', '{"short": "s", "key": []}']
    got = column(spark, values, X.summary_reply)
    assert [(r.short, r.key) if r else None for r in got] == [("s", ["a", "b"]), ("s", ["a"]), ("s", ["one"]), None, None, ("s", ["x"]), ("s", [])]


def test_enriched_text(spark):
    df = spark.createDataFrame([("s", ["a", "b"], "t"), ("", [], "t"), (None, ["a"], "t")], "s string, k array<string>, t string")
    assert [r[0] for r in df.select(X.enriched_text(F.col("s"), F.col("k"), F.col("t"))).collect()] == ["[TÓM TẮT] s\n\n[Ý CHÍNH]\n• a\n• b\n\n[NỘI DUNG ĐẦY ĐỦ]\nt", "[NỘI DUNG ĐẦY ĐỦ]\nt", "[Ý CHÍNH]\n• a\n\n[NỘI DUNG ĐẦY ĐỦ]\nt"]


def test_html(spark):
    values = ["<p>a <b>b</b></p><script>var x = '</p>';</script><style>p {}</style>c<!-- no -->d", "<title>T</title>&lt;x&gt;&nbsp;y", None, "", "open <p>text", "<b>Điều</b> 5.", "<template>no</template><ruby>x<rt>no</rt></ruby>"]
    assert column(spark, values, html.html_to_text) == ["a\nb\nc\nd", "T\n<x> y", "", "", "open\ntext", "Điều\n5.", "x"]


def test_vectors(spark):
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], vectors.normalise, "array<float>") == [[0.6, 0.8], [0.0, 0.0]]


def test_law_numbers_and_separators(spark):
    assert column(spark, ["theo 13/2017/QH14 và 04/2020/NĐ-CP"], X.law_numbers) == [["13/2017/QH", "04/2020/NĐ-CP"]]
    assert column(spark, ["a|b|c", "a"], X.separators) == [2, 0]
