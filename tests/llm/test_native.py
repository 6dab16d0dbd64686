"""Url filter, sharding, mixing and the shared helpers."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keyloom.llm import mixing, sharding, urls
from keyloom.llm.common import components, number_rows

DOCS = "doc_id bigint, text string, source string, _text_key int, size string, place string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


ODD_ROWS = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "t"), (3, "", "t"), (4, "é " * 3000, "s"), (None, None, None), (5, "a b", "s")]


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)] + [(70, 70)], "empty": []}[kind]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)] if edges else edges, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(df).collect()} == find(edges)


def test_row_numbers(spark):
    rows = [(i % 7, i) for i in range(500)]
    got = number_rows(spark.createDataFrame(rows, "a int, b int"), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row_number"])] == sorted(rows)
    assert sorted(r["row_number"] for r in got) == list(range(500))
    assert number_rows(spark.createDataFrame([], "a int"), ["a"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 1000])
def test_permutation_is_one(spark, n):
    got = sharding.permuted(spark.range(n).withColumnRenamed("id", "x").select("x", F.col("x").alias("was")), "x", n, 9).collect()
    assert sorted(r["x"] for r in got) == list(range(n))
    assert all(sharding.permute_python(r["was"], n, 9) == r["x"] for r in got)


def test_shards(spark):
    rng = random.Random(4)
    rows = [*ODD_ROWS, *((rng.randrange(200), f"text {rng.randrange(40)}", "s") for _ in range(300))]
    got = sharding.shard_documents(docs(spark, rows), 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for d, t, _ in rows)
    pick = lambda rows: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert pick(got) == pick(sharding.shard_documents(docs(spark, rows[::-1]).repartition(5), 8).collect())
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0


def model_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [n for n in names if n not in full]
        left = total - sum(most * sizes[n] for n in full)
        share = {n: left * weight[n] / sum(weight[m] for m in rest) for n in rest}
        over = [n for n in rest if share[n] > most * sizes[n]]
        if not over:
            return {n: float(most * sizes[n]) if n in full else share[n] for n in names}
        full |= set(over)


def test_mix_counts_and_documents(spark):
    rng = random.Random(6)
    rows = [*ODD_ROWS, *((100 + i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["big"] * 8 + ["s", "t", "ü", None])) for i in range(600))]
    got = mixing.mix_counts(docs(spark, rows)).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((d, words(t), s) for d, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    targets = model_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    longest = {s: max(words(t) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= 2 * longest[s] + 1 for s in sizes)
    frame = docs(spark, rows)
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    want = Counter()
    for r in got:
        want[(r["doc_id"], r["source"], r["text_key"])] += r["copies"]
    key = lambda r: (r["doc_id"], r["source"], r["k"])
    assert Counter(key(r) for r in mixed.withColumn("k", F.xxhash64("text")).collect()) == +want


def test_mix_of_nothing(spark):
    assert mixing.mix_counts(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0
    silent = mixing.mix_counts(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in silent)


PAGES = [
    (1, "https://WWW.Example.com/en/712?x=1#y", None), (2, "http://example.com/en/8", ""), (3, "http://a.net/de/1", "x"), (4, "http://b.example.net/de/88", "x"),
    (5, "http://notcom/en/1", "x"), (6, None, "x"), (7, "no scheme com/en/", "x"), (8, "http://x.org/es/1", '<link rel="canonical" href="http://y.info/p?a=1&amp;b=2">'),
    (9, "http://y.info/p?a=1&b=2", "x"), (10, "http://z.info/1", '<META content="0; URL=http://y.info/p?a=1&amp;b=2" HTTP-EQUIV=refresh>'),
    (11, "http://q.info/1", "<link href='/2' rel='canonical'>"), (12, "http://q.info/2", "x"), (13, "http://a.net/de/9", '<link rel=canonical href=http://q.org/es/3>'),
    (14, "http://q.org/es/3", "x"), (15, "http://k.info/", '<link rel=canonical href="http://q.org/es/3">'), (9, "http://y.info/p?a=1&b=2", "x"), (16, "://", None),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, component string")


def test_url_verdicts(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_pages(pages(spark)).collect()}
    assert got == {
        1: ("www.example.com", "/en/712", "example.com/en/7", "allow"), 2: ("example.com", "/en/8", "com/en/", "block"), 3: ("a.net", "/de/1", "net/de/", "allow"),
        4: ("b.example.net", "/de/88", "example.net/de/8", "block"), 5: ("notcom", "/en/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("x.org", "/es/1", "org/es/", "block"), 9: ("y.info", "/p", None, "block"), 10: ("z.info", "/1", None, "block"), 11: ("q.info", "/1", None, "allow"),
        12: ("q.info", "/2", None, "allow"), 13: ("a.net", "/de/9", "net/de/", "allow"), 14: ("q.org", "/es/3", "org/es/", "block"), 15: ("k.info", "/", None, "allow"), 16: ("", "", None, "allow"),
    }


def test_relative_and_repeated_targets(spark):
    page = "http://h.info/a/b/c.html?q=1#f"
    want = {
        "page2.html": "http://h.info/a/b/page2.html", "?id=3": "http://h.info/a/b/c.html?id=3", "../x": "http://h.info/a/x", "../../../x/./y": "http://h.info/x/y",
        ".": "http://h.info/a/b/", "/r?u=http://z.info/": "http://h.info/r?u=http://z.info/", "//k.info/x": "http://k.info/x", "HTTPS://k.info/y": "HTTPS://k.info/y",
    }
    html = "".join(f'<link rel="canonical" href="{t}">' for t in [*want, "#f", "mailto:a@b"]) + "".join(f'<meta http-equiv="refresh" content="0; url=r{i}">' for i in (1, 2))
    got = urls.page_edges(pages(spark, [(1, page, html), (2, "http://n.info", '<link rel=canonical href=x>'), (3, "bare", '<link rel=canonical href=x>')])).collect()
    assert {r["b"] for r in got if r["a"] == page} == {*want.values(), "http://h.info/a/b/r1", "http://h.info/a/b/r2"}
    assert {r["b"] for r in got if r["a"] != page} == {"http://n.info/x"}
    judged = urls.judge_pages(pages(spark, [(1, "http://q.org/es/3", '<link rel=canonical href="http://v.info/1"><link rel=canonical href="http://v.info/d/2">'), (2, "http://v.info/d/1", '<link rel=canonical href="2">')]))
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "block"}


def test_url_edges_rows_and_tables(spark):
    assert urls.judge_pages(pages(spark)).count() == len(PAGES)
    assert urls.judge_pages(pages(spark, [])).count() == 0
    redirects = spark.createDataFrame([("http://q.info/1", "http://r.org/es/5"), (None, "x")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(pages(spark), redirects=redirects).collect()}
    assert got[11] == got[12] == "block"
    assert {r["verdict"] for r in urls.judge_pages(pages(spark).drop("html"), rules=[]).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.rule_for(F.lit("a"), F.lit("/"), [("a/", "maybe")])
    with pytest.raises(ValueError):
        urls.judge_pages(pages(spark), rules=spark.createDataFrame([("a/", None)], "rule string, verdict string"))


def test_many_rules_and_long_urls(spark):
    rng = random.Random(8)
    name = lambda n: ".".join(rng.choice(["a", "b", "com", "Net"]) for _ in range(n))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4)))
    rules = [(name(rng.randrange(1, 4)) + rng.choice([path(), ""]), rng.choice(["allow", "block"])) for _ in range(60)] + list(urls.RULES)
    rows = [(i, f"http://{name(rng.randrange(1, 5))}{path()}", f"<link rel=canonical href='http://{name(2)}{path()}'>") for i in range(150)] + PAGES
    rows += [(900, "http://a.com/" + "x" * 100_000, "x" * 100_000), (901, "http://" + "a." * 5_000 + "com/x", None), (902, None, None)]

    def plain(url):
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0].lower()
        way = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(r), v, r) for r, v in rules for n, s, p in [r.partition("/")] if f".{host}".endswith(f".{n.lower()}") and way.startswith(s + p)]
        return max(fits)[2] if fits else None

    few = {tuple(r) for r in urls.judge_pages(pages(spark, rows), rules=rules).collect()}
    many = urls.judge_pages(pages(spark, rows), rules=spark.createDataFrame([*rules, rules[0], (None, "block")], "rule string, verdict string"))
    assert {tuple(r) for r in many.collect()} == few and many.count() == len(rows)
    assert {(r[0], r[4]) for r in few} == {(i, plain(u)) for i, u, _ in rows}
    listed = urls.ruled(pages(spark, rows).select("url"), "url", rules, literal=1)
    assert {(r["url"], r["_own"] and r["_own"]["rule"]) for r in listed.collect()} == {(u, plain(u)) for _, u, _ in rows}
