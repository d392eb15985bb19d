"""Sharding, WARC, mixing and HTML extraction on small tables."""

import base64
import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from querent.llm import html_extract as he
from querent.llm.mixing import mix, mixed_texts, permute, resample, source_targets
from querent.llm.sharding import Shard, grow, place, plan_tree, shard_documents, shard_rows
from querent.llm.warc import archive_round_trip

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "one two three", "en", "a", 13), (2, None, "en", "a", None), (3, "", None, None, 0),
    (4, "x " * 30_000, "en", "b", 60_000), (5, "dup dup", "de", "b", 7), (5, "dup dup", "de", "b", 7),
    (None, "no id ü", "fr", None, 7), (6, " \t\n ", "en", "c", 4), (7, "\x00 nul", "en", "c", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def clash(df, *names):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in names])


# sharding


def test_shards(spark, odd):
    rows = shard_documents(clash(odd, "shard", "slot", "size", "_block", "_base")).collect()
    assert len(rows) == len(ODD)
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert sizes == Counter((d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t, *_ in ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_growth_moves_rows_only_into_the_new_shard(spark):
    tree = plan_tree(16)
    for _ in range(3):
        more = grow(tree)
        rows = spark.range(20_000).select(place("id", tree).alias("a"), place("id", more).alias("b")).collect()
        moved = Counter(r["b"] for r in rows if r["a"] != r["b"])
        assert set(moved) == {more[-1].number} and moved[more[-1].number] > 20_000 / len(more) / 2
        tree = more


def test_weights_and_confinement(spark):
    tree = (Shard("r0", "k0", 0, 1), Shard("r0", "k1", 1, 2), Shard("r1", "k0", 2, 3), Shard("r1", "k0", 3, 0))
    heavier = (*tree[:2], Shard("r1", "k0", 2, 6), tree[3])
    rows = spark.range(30_000).select(place("id", tree).alias("a"), place("id", heavier).alias("b")).collect()
    n = Counter(r["a"] for r in rows)
    assert n[3] == 0 and all(abs(n[i] / 30_000 - w / 6) < 0.02 for i, w in enumerate((1, 2, 3)))
    assert {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]} == {(0, 2), (1, 2)}


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert shard_documents(none).count() == 0
    assert shard_rows(clash(none, "shard")).columns == [*none.columns, "shard"]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive_round_trip(pages).count() == 0
    assert he.extract_pages(pages).count() == 0
    assert mix(none).taken().count() == 0 and resample(none).columns == none.columns


# WARC


def test_archive_round_trip(spark):
    pages = [
        (3, "u3", "same"), (1, "u\r\n1", "same"), (2, None, "a\r\n\r\nWARC/1.1\r\n\r\nb"), (9, "u", "same"), (4, "u", None),
        (5, "u", ""), (None, "u", "same"), (7, "u", "ü" * 50_000), (8, "u", "lone"), (8, "u", "lone"),
    ]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"), "payload_digest", "block")
    got = archive_round_trip(df).collect()
    firsts = {}
    for p, _, h in pages:
        if p is not None:
            firsts[h or ""] = min(p, firsts.get(h or "", p))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = firsts[h or ""]
        want.append((p, len(raw), digest, "response" if p == first else "revisit", None if p == first else first))
    assert Counter(map(tuple, got)) == Counter(want)


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in archive_round_trip(df, min_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# mixing


def fill(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        open_ -= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1000, None: 7}, {"a": 10}, {"a": 0, "b": 50, "ä": 1, "z": 400, "é": 3}, {None: 4, "x": 4},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = fill(sizes, (5, 2, 1), 3)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 2**63 + 5):
            got = permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))
    a, b = (permute(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_mix_takes_near_targets(spark, odd):
    words = {"a": 40, "b": 9, "c": 200, None: 3}
    docs = spark.createDataFrame(
        [(i * 10 + j, " ".join(["w"] * (words[s] + j)), "en", s, 0) for i, s in enumerate(words) for j in range(60)], DOCS
    )
    rows = mix(docs, block_words=8, block_rows=50).taken().collect()
    assert len(rows) == 240 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix(docs, block_words=8, block_rows=50).taken().collect()), key=repr)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r["source_id"]][0] += r["taken"]
        by[r["source_id"]][1] = r["target"]
    assert all(abs(t - want) < 0.03 * want + 8 for t, want in by.values())
    slots = mixed_texts(docs, block_words=8, block_rows=50)
    n = Counter()
    for r in slots.collect():
        n[r["source_id"]] += len(r["text"].split())
    assert {k: v[0] for k, v in by.items()} == n


def test_mix_odd_rows(spark, odd):
    rows = mix(clash(odd, "size", "start", "block", "code", "target")).taken().collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows) == sorted(
        (d or 0, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in ODD
    )
    out = resample(clash(odd, "_n", "_id", "_copy", "_text", "_code"))
    assert out.columns == [*odd.columns, "_n", "_id", "_copy", "_text", "_code"]
    assert {r["doc_id"] for r in out.collect()} <= {d for d, *_ in ODD}


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy it now.</div>
<article><h1>Head &amp; line</h1><p><b>First  words
here and more of them to read.<br><p>Second &lt;part&gt; with several words.</p>{more}</article>
<footer>&copy; somebody, all rights reserved by them.</footer></body></html>"""
TEXT = "Head & line\nFirst words here and more of them to read.\nSecond <part> with several words."


def test_extract(spark):
    more = '<div class="comments"><p>I like this page very much indeed.</p></div><form><p>Name: please fill in</p></form>'
    pages = [
        (1, "u1", PAGE.format(more="")), (2, "u2", PAGE.format(more="<p>Third.</p>")), (3, "u3", PAGE.format(more=more)),
        (4, None, None), (5, "u5", ""), (6, "u6", "<p"), (7, "u7", "<nav><a>menu</a></nav>"), (8, "u8", "</p></div> & <"),
        (2, "u2", PAGE.format(more="<p>Third.</p>")), (9, "u9", "<article><p>" + "long text " * 40_000 + "</article>"),
    ]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string"), "text", "n_chars", "kind")
    got = he.extract_pages(df).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == TEXT and by[2] == TEXT + "\nThird." and by[3] == TEXT
    assert by[4] == by[5] == by[7] == "" and by[9] == ("long text " * 40_000).strip()


def test_extract_around_asides(spark):
    lead, body = "<h1>Head line</h1><p>" + "lead " * 10, "<p>" + "body " * 200
    advert = '<div class="ad"><p>' + "buy " * 40 + "</p></div>"
    form = "<form><p>" + "letter " * 40 + "</p><button>Send</button></form>"
    head = '<header class="header"><h1>Head line</h1></header><p>' + "lead " * 10
    want = f"Head line\n{' '.join(['lead'] * 10)}\n{' '.join(['body'] * 200)}"
    other = PAGE.format(more="")
    start, end = other[: other.index("<article>")], other[other.index("<footer>") :]
    page = lambda text: f"{start}<article>{text}</article>{end}"
    pages = [
        page(lead + advert + body), page(lead + form + body), page(lead + advert + form + body),
        page(lead + body).replace("<body", "<body class='right-sidebar'"),
        page(lead + body).replace("<html", "<html class='no-widget'"),
        page(lead + body).replace("<article", "<article class='has-comments share' role='main'"),
        page(lead + body).replace("article>", "main>").replace("<main", "<main id='with-navigation'"),
        page(head + advert + body),
    ]
    rows = list(enumerate([*pages, *[other] * 5]))
    df = spark.createDataFrame([(i, "u", p) for i, p in rows], "page_id long, url string, html string")
    by = {r["page_id"]: r["text"] for r in he.extract_pages(df).collect()}
    assert [by[i] for i in range(len(pages))] == [want] * len(pages)
    tail = {r["page_id"]: r["text"] for r in he.extract_pages(
        spark.createDataFrame([(0, "u", page("<p>" + "body " * 200 + "</p>" + advert + "<p>the end"))], df.schema)
    ).collect()}
    assert tail[0] == f"{' '.join(['body'] * 200)}\nthe end"


def test_best_run_is_the_best():
    chance = np.random.default_rng(0)
    for _ in range(200):
        s = list(chance.integers(-5, 6, chance.integers(0, 12)).astype(float))
        a, b = he.best_run(s)
        most = max([sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)], default=0)
        assert sum(s[a:b]) == max(most, 0)


def test_extract_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in he.extract_pages(df).join(df.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        flat = he.html.unescape(re.sub(r"<[^>]*>", " ", body))
        assert r["text"].split() == flat.split(), r["page_id"]


def test_names_do_not_mark_what_wraps_the_article():
    body = "<h1>Head</h1><p>one two three four five six seven eight nine ten eleven twelve</p>"
    text = "Head\none two three four five six seven eight nine ten eleven twelve"
    for page in (
        "<div class='layout has-sidebar'><article>{}</article><div class='sidebar'>a menu</div></div>",
        "<div id=page class='no-banner'><main>{}</main></div><div class=comments>what readers say</div>",
        "<article>{}</article><div class='comments'><article class=x>what readers say of it</article></div>",
        "<div class='content menu-open'>{}</div>",
        "<article>{}<div class='ad content'>buy now</div></article>",
        "<div class='comment-content'>first</div><article>{}</article>",
    ):
        assert he.extract(page.format(body), he.Weights()) == text, page
