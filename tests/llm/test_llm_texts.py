"""Toxicity, personal data, near duplicates, language models, decontamination, neighbours, pipeline."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from compare import ROOT, compare, duck
from querent.llm import lm_scoring, toxicity
from querent.llm.ann import build_index, chi_square_quantile, nearest
from querent.llm.components import components
from querent.llm.decontaminate import contamination
from querent.llm.pii import KINDS, find_spans, personal_data, score_instances
from querent.llm.queries import QUERIES, TWINS
from querent.llm.simhash import deduplicate, fingerprint, near_duplicates, trie_links

SF = f"{ROOT}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "One two three FOUR", "en", "a", 18), (2, None, "en", "a", None), (3, "", None, None, 0),
    (4, "x " * 30_000, "en", "b", 60_000), (5, "dup dup", "de", "b", 7), (5, "dup dup", "de", "b", 7),
    (None, "no id ü", "fr", None, 7), (6, " \t\n ", "en", "c", 4), (7, "\x00 nul", "en", "c", 5),
    (8, "1" * 50_000 + " a@" + "b" * 50_000, "en", "c", 9), (9, "one two  three four", "en", "a", 18),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *[
        F.lit("x").alias(n) for n in ("score", "toxic", "code", "print", "ids", "wanted", "found", "words", "base", "marks")
    ])


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    result = compare(spark, duck(SF), QUERIES[name], TWINS[name], SF)
    assert result.startswith("ok"), result


# toxicity


def test_held_out_toxicity(spark):
    sf = f"{ROOT}/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert all(crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    # documents of low quality may be labelled toxic without a word that shows it
    bad = [r for r in rows if r["toxic"] == 1 and r["quality"] == 1]
    good = [r for r in rows if r["toxic"] == 0]
    caught = sum(r["predicted"] for r in bad)
    wrong = sum(r["predicted"] for r in good)
    assert caught / len(bad) > 0.9 and wrong / len(good) < 0.02


def test_neighbours_are_exact():
    chance = random.Random(1)
    terms = [f"t{i}" for i in range(30)]
    idf = np.array([chance.uniform(1, 5) for _ in terms])
    import pandas as pd

    words = {d: Counter(chance.choices(terms, k=chance.randint(1, 8))) for d in range(500)}
    sample = pd.DataFrame({"doc_id": list(words), "toxic": [d % 3 == 0 for d in words]}).astype("int64")
    postings = pd.DataFrame([(d, w, n) for d, c in words.items() for w, n in c.items()], columns=["doc_id", "word", "n"])
    index = toxicity._build(terms, idf, sample, postings, {0: 1000, 1: 100})
    vectors = {d: index.vector(Counter({int(w[1:]): n for w, n in c.items()})) for d, c in words.items()}
    for _ in range(50):
        q = index.vector(Counter(chance.choices(range(30), k=4)))
        all_ = {d: sum(q[t] * v.get(t, 0) for t in q) for d, v in vectors.items()}
        want = sorted((-s, d) for d, s in all_.items() if s > 1e-12)[:16]
        found, cosines = index.nearest(q, 16)
        assert np.allclose(cosines, [-s for s, _ in want])
        assert all(abs(all_[int(i)] - c) < 1e-9 for i, c in zip(index.ids[found], cosines, strict=True))


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.score_documents(odd, marks).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] is not None for r in rows)
    assert toxicity.score_documents(odd.limit(0), labels).count() == 0


# personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
                "card": lambda v: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda v: 9 <= len(digits) <= 15,
            }[kind](m[0]):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check_personal(spark, df):
    for r in personal_data(df.withColumn("t", F.col("text")).select("doc_id", "text")).join(
        df.select("doc_id", F.col("text").alias("t")), "doc_id"
    ).collect():
        want = base_spans(r["t"])
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (r["doc_id"], r["spans"], listed)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x == i for _, x, _ in want) for i in range(4)]
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def test_base_spans_against_brute_force(spark, given):
    chance = random.Random(5)
    texts = ["".join(chance.choices("a1@.+- ()2%_9é😀\n", k=chance.randint(0, 60))) for _ in range(1500)]
    texts += ["x@a.com_b@c.d", "1.2.3.4.5.6.7.8 0001.255.0.256", "4111 1111-1111 1111 +1 (555) 123-4567 é 4111111111111111"]
    check_personal(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    check_personal(spark, given.select("doc_id", "text"))


def test_contexts_discover_unseen_identifiers(spark):
    def card(i):
        body = f"4{i:014d}"
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    seeds = [(i, f"Order {i} paid by card number {card(i)} with thanks") for i in range(40)]
    wrong = card(77)[:-1] + str((int(card(77)[-1]) + 1) % 10)
    rows = [*seeds, (100, f"paid by card number {wrong} with thanks"), (101, f"serial of the part {wrong[::-1]} in stock")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in personal_data(df).collect()}
    assert by[100]["n_card"] == 0 and by[100]["spans"] == "card:20:36" and by[101]["spans"] == ""
    assert all(by[i]["spans"].startswith("card:") for i in range(40))
    assert score_instances(find_spans(df)).count() == 1


def test_personal_odd(spark, odd):
    rows = personal_data(odd).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" and r["n_email"] == 0 for r in rows)
    assert personal_data(odd.limit(0)).count() == 0


# near duplicates


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints, budget=2):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_fingerprints(given, odd):
    for r in [*given.limit(60).collect(), *odd.collect()]:
        assert fingerprint(r["text"]) % 2**64 == slow_print(r["text"])


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_trie_finds_what_brute_force_finds(depth):
    chance = random.Random(depth)
    seeds = [chance.getrandbits(64) for _ in range(30)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(chance.randint(0, 20)):
            s ^= sum(1 << b for b in chance.sample(range(64), chance.randint(1, 3)))
            prints.add(s)
    prints = sorted(prints)
    want = slow_roots(prints)
    values = np.array(prints, np.uint64)
    groups = {p >> (64 - depth) for p in prints}
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in groups:
        for b in groups:
            if a <= b and (a ^ b).bit_count() <= 2:
                mine = values[[p >> (64 - depth) in (a, b) for p in prints]]
                cut = sum(int(v) >> (64 - depth) == a for v in mine)
                left = slice(0, cut)
                got = trie_links(mine, left, left if a == b else slice(cut, len(mine)), depth)
                for v, r in zip(mine.tolist(), mine[got].tolist(), strict=True):
                    x, y = find(v), find(r)
                    root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 400), (7, 7), (None, 1), (1, 0), (0, 1)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(got) and got == {i: 0 for i in range(201)} | {300: 300, 400: 300, 500: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, given, odd):
    for df in (given.select("doc_id", "text"), odd):
        rows = df.collect()
        prints = {r["text"]: slow_print(r["text"]) for r in rows}
        roots = slow_roots(sorted(set(prints.values())))
        least = {}
        for r in rows:
            c = roots[prints[r["text"]]]
            if r["doc_id"] is not None:
                least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
        want = Counter((r["doc_id"], prints[r["text"]], least.get(roots[prints[r["text"]]])) for r in rows)
        got = Counter((r["doc_id"], r["print"] % 2**64, r["component_id"]) for r in near_duplicates(df).collect())
        assert got == want
        kept = deduplicate(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(
            least.get(c) for c in {roots[p] for p in prints.values()}
        )
    assert near_duplicates(odd.limit(0)).count() == 0 and deduplicate(odd.limit(0)).count() == 0


def test_deduplicate_keeps_components_apart(spark):
    def near_pair(word):
        base = " ".join(f"{word}{i}" for i in range(300))
        near = next(
            t for i in range(1000)
            if (t := f"{base} end{i}") and 0 < ((fingerprint(t) ^ fingerprint(base)) % 2**64).bit_count() <= 2
        )
        return base, near

    (a, a8), (b, b9), (n, m) = map(near_pair, "abn")
    # 5 is the smallest id of two components; the last component has no id at all
    rows = [(5, a), (8, a8), (5, b), (9, b9), (None, n), (None, m), (None, m)]
    kept = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    assert len(kept) == 3 and got[5, a] == got[5, b] == 1 and got[None, n] + got[None, m] == 1


# language models


def test_cross_entropy_difference(spark, odd):
    texts = [(i, t, "", "", 0) for i, t in enumerate(["the cat sat", "the dog sat. The cat", "a dog", None, "!!", "zebra the cat"])]
    docs = spark.createDataFrame(texts, DOCS)
    good = spark.createDataFrame([(0,), (5,), (5,), (None,), (77,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, good, size=5, weight=2.0).collect()}
    words = {i: re.findall("[a-z]+", (t or "").lower()) for i, t, *_ in texts}
    n = Counter(w for ws in words.values() for w in ws)
    known = {w: i + 2 for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w))[:3])}
    ids = {i: [1, *(known.get(w, 0) for w in ws)] for i, ws in words.items()}

    def model(of):
        pairs = Counter(p for i in of for p in zip(ids[i], ids[i][1:], strict=False))
        single = Counter(b for (_, b), c in pairs.items() for _ in range(c))
        first = Counter(a for (a, _), c in pairs.items() for _ in range(c))
        total = sum(single.values())
        return lambda a, b: -math.log(
            (pairs[a, b] + 2.0 * (single[b] + 0.5) / (total + 2.5)) / (first[a] + 2.0)
        )

    target, background = model([0, 5]), model(list(ids))
    for i, row in ids.items():
        pairs = list(zip(row, row[1:], strict=False))
        assert got[i]["n_words"] == len(pairs)
        for name, m in (("target_loss", target), ("background_loss", background)):
            want = sum(m(a, b) for a, b in pairs) / len(pairs) if pairs else 0.0
            assert abs(got[i][name] - want) < 1e-5
        assert abs(got[i]["score"] - (got[i]["target_loss"] - got[i]["background_loss"])) < 1e-9
    assert lm_scoring.score_documents(odd, good).count() == len(ODD)
    assert lm_scoring.score_documents(odd.limit(0), good.limit(0)).count() == 0


@pytest.mark.parametrize("share, bucket", [(1, 1 << 20), (6, 50), (1_024, 50), (1_024, 1 << 20)])
def test_cross_entropy_of_all_words(spark, monkeypatch, share, bucket):
    monkeypatch.setattr(lm_scoring, "BUCKET", bucket)
    chance = random.Random(share)
    texts = [" ".join(f"w{int(chance.paretovariate(0.6))}" for _ in range(chance.randint(0, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i % 38, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"].split()) for r in docs.collect()]
    size = len({w for _, ws in rows for w in ws}) + 2

    def model(of):
        pairs, first = Counter(), Counter()
        for _, ws in of:
            pairs.update(zip(["", *ws], ws, strict=False))
            first.update(["", *ws][: len(ws)])
        single = Counter(w for _, ws in of for w in ws)
        return lambda a, b: -math.log(
            (pairs[a, b] + 20 * (single[b] + 0.5) / (single.total() + 0.5 * size)) / (first[a] + 20)
        )

    models = model([r for r in rows if r[0] < 15]), model(rows)
    mean = lambda m, ws: sum(m(a, b) for a, b in zip(["", *ws], ws, strict=False)) / len(ws) if ws else 0.0
    want = sorted((d, len(ws), *(round(mean(m, ws), 6) for m in models)) for d, ws in rows)
    got = lm_scoring.score_documents(docs, docs.where("doc_id < 15").select("doc_id"), share=share).collect()
    got = sorted((r["doc_id"], r["n_words"], round(r["target_loss"], 6), round(r["background_loss"], 6)) for r in got)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=3e-6)


def test_counts_and_places_come_back():
    chance = np.random.default_rng(4)
    for top in (1, 200, 1 << 20, 1 << 40):
        a, b = chance.integers(0, top, 300), np.zeros(0, np.int64)
        assert [x.tolist() for x in lm_scoring._large(lm_scoring._small(a, b, a[:7]))] == [a.tolist(), [], a[:7].tolist()]
        assert lm_scoring._summed(lm_scoring._steps(a)).tolist() == a.tolist()


def test_rare_words_tell_documents_apart(spark):
    # 2,000 frequent words of one language, and a rarer one of which half is target
    many = [(i, " ".join(f"often{j}" for j in range(2_000))) for i in range(20)]
    rare = [(100 + i, " ".join(f"{'good' if i % 2 else 'bad'}{j}" for j in range(20))) for i in range(10)]
    docs = spark.createDataFrame(many + rare, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs, docs.where("doc_id >= 100 and doc_id % 2 = 1")).collect()}
    assert max(got[100 + i] for i in range(1, 10, 2)) + 1 < min(got[100 + i] for i in range(0, 10, 2))


@pytest.mark.parametrize("size, spread", [(20, 1), (200, 1), (200, 16), (40_000, 1)])
def test_vocabulary_is_exact(given, size, spread):
    words = Counter()
    for r in given.select("text").collect():
        words.update(lm_scoring.words_of(r["text"]))
    want = sorted(words, key=lambda w: (-words[w], w))[: size - 2]
    assert lm_scoring.vocabulary(given.repartition(6), size, spread) == want


def test_vocabulary_of_even_words(spark):
    # what the tasks hold back reaches as far as what they name: all words are counted
    docs = spark.createDataFrame([(f"w{i} w{i + 1}",) for i in range(300)], "text string").repartition(5)
    assert lm_scoring.vocabulary(docs, 12, 1) == sorted(f"w{i}".encode() for i in range(1, 300))[:10]


# decontamination


def test_contamination_against_brute_force(spark, odd):
    chance = random.Random(3)
    word = lambda: chance.choice(["a", "B", "c1", "é"])
    docs = [(i, " ".join(word() for _ in range(chance.randint(0, 120)))) for i in range(60)]
    items = [(i, ", ".join(word() for _ in range(chance.randint(0, 16)))) for i in range(25)]
    items += [(30, None), (None, docs[0][1]), (None, docs[9][1]), (None, None), (3, docs[5][1]), (31, "a")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    got = {
        r["doc_id"]: r for r in contamination(
            spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)),
            spark.createDataFrame(items, "item_id long, text string"),
        ).collect()
    }
    for d, text in docs:
        words, hit, by = split(text), set(), set()
        for item, t in items:
            w = split(t)
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[s : s + n]:
                        hit |= set(range(at, at + n))
                        by.add(item if item is None else str(item))
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(by))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(by - {None})).encode()).hexdigest()
        assert r["contaminated"] == bool(hit)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd, none).where("contaminated").count() == 0
    assert contamination(odd.limit(0), none).count() == 0


# neighbours


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet(f"{ROOT}/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in nearest(build_index(vectors), vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = n = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        found = got[int(ids[i])]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(v - s[np.flatnonzero(ids == d)[0]]) < 1e-12 for d, v in found.values())
        hits, n = hits + len(best & {d for d, _ in found.values()}), n + 5
    assert hits / n >= 0.95


def test_neighbours_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 400)] + [
        (0, [1.0, 2.0, 3.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]),
        (5, [inf, 1.0, 1.0]), (6, [1.0, 1.0]), (7, [-1.0, -2.0, -3.0]), (None, [1.0, 2.0, 3.0]), (50, []), (7, [-1.0, -2.0, -3.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    found = nearest(build_index(df, block_rows=64), df.where("vec_id < 100")).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(by[0]) == [(i + 1, 100 + i) for i in range(5)]
    assert set(by) == {0, 7} and len(by[7]) == 5
    assert nearest(build_index(df.limit(0)), df).count() == 0
    assert nearest(build_index(df), df.limit(0)).count() == 0
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3


# pipeline


def test_pipeline(spark):
    from querent.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, now, SF), name)
        if name != "sharding":
            assert out.columns == docs.columns
        before, after = (sorted(r["doc_id"] for r in x.collect()) for x in (now, out))
        if name == "toxicity":
            judged = toxicity.score_documents(now, labels).where("predicted = 0")
            assert after == sorted(r["doc_id"] for r in judged.collect())
        elif name == "near_duplicates":
            assert after == sorted({r["component_id"] for r in near_duplicates(now).collect()})
        elif name == "decontamination":
            clean = contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated")
            assert after == sorted(r["doc_id"] for r in clean.collect()) and len(after) < len(before)
        elif name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 3
        else:
            assert after == before and {r["shard"] for r in out.collect()} <= set(range(16))
        now = out
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == now.count()
