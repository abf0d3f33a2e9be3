"""Operators 4 and 7: rules and leaks against plain loops."""

import math
import random
import re

from corpusflow.llm import decontaminate, queries, url_filter


def plain_verdict(rules, url):
    host, path = url_filter.split_url(url)
    fits = [(len(h), len(p), v, h + p) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow")))


def test_urls(spark):
    rules = queries.URL_RULES + [("block", "a.com", "/x"), ("allow", "a.com", "/x/y"), ("block", "a.com", "/x/yz/"), ("block", "org", "")]
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://com", "https://WWW.Example.com/en/1?q#f", "http://b.a.com/xx", "http://a.com/x/yz/", "http://a.com/x/y", "ftp://a.com/x?/y", "http://evilcom/", "http://x.org", "http://É.net/es/", "http://net:80/es/"]
    urls += [rng.choice(["http://", "https://"]) + ".".join(rng.choice(["www", "example", "a", "com", "net", "org"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/", "/en/", "/es/1", "/x", "/x/y", "/x/yz/q", "/fr/?a"]) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {i: plain_verdict(rules, u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def plain_leaks(docs, items, least_score, least_overlap):
    """Every window of every document is scored against every item, without an index."""
    toks = {i: words(t or "") for i, t in items}
    n = len(items)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log1p((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    lengths = [len(t) for t in toks.values() if t]
    mean = sum(lengths) / len(lengths)
    part = lambda w, t: idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean))
    by_class = {}
    for i, t in toks.items():
        if t:
            c = 0
            while len(t) > 64 * 4**c:
                c += 1
            by_class.setdefault(c, []).append(i)
    out = set()
    for d, text in docs:
        w = words(text or "")
        for members in by_class.values():
            stride = max(len(toks[i]) for i in members)
            for start in range(0, max(1, len(w)), stride):
                seen = set(w[start : start + 2 * stride])
                for i in members:
                    t = toks[i]
                    own = sum(part(x, t) for x in set(t))
                    half = (len(t) + 1) // 2
                    share = lambda xs: sum(idf[x] for x in set(xs) & seen) / sum(idf[x] for x in set(xs))
                    if sum(part(x, t) for x in set(t) & seen) / own >= least_score and min(share(t[:half]), share(t[half:] or t)) >= least_overlap:
                        out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)] + ["the", "of", "and"] * 40
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 8, 30, 50, 90])))) for i in range(40)] + [(90, None), (91, "!!"), (92, "v1 v2 v3 v4")]
    docs = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            t = words(items[rng.randrange(40)][1])
            for _ in range(rng.randrange(0, 1 + len(t) // 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper()))
    docs += [(None, items[3][1]), (5, None), (6, "")]
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_leaks(docs, items, 0.5, 0.7)
    assert all(r.score >= 0.5 and r.question_overlap >= 0.7 and r.answer_overlap >= 0.7 for r in got)


def test_leaks_in_slices_and_empty(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " * 500 + item), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "other words here"), (3, "more of them")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items, max_index_bytes=60).collect()] == [(1, 1)]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), items).count() == 0


def test_planted_benchmark_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = ({r[0]: r.text for r in spark.read.parquet(f"{sf}/{n}.parquet").select(k, "text").collect()} for n, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    verbatim = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, sf).collect()}
    assert verbatim <= got and len(got) <= 1.3 * len(verbatim)
