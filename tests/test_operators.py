"""Operators whose large-input path differs from the small one: both must agree."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from querent.functions import scores as sc
from querent.operators import neardup as nd
from querent.operators import packing, ranking
from querent.operators import vectors as vx
from querent.plans import bank as pb
from querent.sources import banks as bk
from querent.sources import files as fl
from querent.sources import sinks as sk
from querent.sources import tables as tb
from querent.session import scratch_path


def test_blocks_do_not_change_ordinals_or_running_best(spark):
    df = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    for parts in (1, 20):
        ordinals = ranking.with_ordinal(df, ["k"], "id", parts=parts)
        best = ranking.with_best_before(df, ["k"], "id", F.struct("v", "id"), parts=parts)
        state = (sorted(map(tuple, ordinals.collect())), sorted(map(tuple, best.select("id", "best_before.v").collect())))
        if parts == 1:
            want = state
        else:
            assert state == want


def test_equal_orders_of_one_group_are_split(spark):
    df = spark.range(200_000).select("id", F.lit(1).alias("k"), F.lit(7).alias("o"))
    ranged = ranking._ranged(df, ["k"], ["o"], 16)
    sizes = [r["count"] for r in ranged.groupBy("_b").count().collect()]
    assert max(sizes) < 200_000 / 16 * 2
    got = ranking.with_ordinal(df, ["k"], "o", parts=16).agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal"))
    assert tuple(got.first()) == (1, 200_000, 200_000)


def test_a_large_group_packs_in_time(spark):
    import time

    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("t"))
    start = time.time()
    row = packing.pack_batches(df, ["k"], "o", "t").agg(F.count("*"), F.max("batch")).first()
    assert row[0] == 200_000 and 200_000 / 60 < row[1] < 200_000 / 40
    assert time.time() - start < 30


def test_null_orders_come_first(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, None, "b"), (None, 1, "c"), (None, 3, "d")], "k int, o int, v string")
    assert {r["v"] for r in ranking.first_seen(df, ["k"], "o").collect()} == {"b", "c"}
    assert {r["v"] for r in ranking.latest(df, ["k"], "o").collect()} == {"a", "d"}


def test_large_groups_pack_like_small_ones(spark):
    rnd = random.Random(3)
    rows = [(i % 7 and 0 or i % 2, i, "x" * rnd.randint(0, 90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, o int, t string")
    small = packing.pack_batches(df, ["k"], "o", "t", 300, 8).collect()
    large = packing.pack_batches(df, ["k"], "o", "t", 300, 8, block_rows=40).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))

    def loop(items):
        out, n, used, batch = [], 0, 0, 1
        for t in items:
            if n and (used + len(t) + 2 > 300 or n >= 8):
                batch, n, used = batch + 1, 1, len(t)
            else:
                n, used = n + 1, used + len(t) + 2
            out.append(batch)
        return out

    for k in (0, 1):
        mine = sorted((r["o"], r["batch"]) for r in small if r["k"] == k)
        assert [b for _, b in mine] == loop([t for kk, _, t in rows if kk == k])


def _score(a, b):
    def grams(t):
        w = t.split()
        return [set(w), {t[i:i + 2] for i in range(len(t) - 1)}, set(zip(w, w[1:]))]

    values = [len(x & y) / len(x | y) for x, y in zip(grams(a), grams(b)) if x and y]
    return sum(values) / len(values) if values else 0.0


def _texts(rnd, families, edited):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = ["solo", "solo solo", "", "other", "a b a b a", "b a b a b a"]
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(60)]
        for edits in range(edited):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(60)] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    return list(dict.fromkeys(texts))


def test_near_links_against_all_pairs(spark):
    texts = _texts(random.Random(5), 25, 4)
    texts += [texts[8], texts[4] + " b", texts[12].upper() + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rank = lambda i: (len(texts[i]), -i)
    sets = lambda t: [frozenset(x) for x in (t.split(), zip(t, t[1:]), zip(t.split(), t.split()[1:]))]
    of = {}
    for i, t in enumerate(texts):
        key = tuple(sets(t.lower().replace("!", ""))) if t else i
        of.setdefault(key, []).append(i)
    best = {m: max(c, key=rank) for c in of.values() for m in c}
    assert len(of) < len(texts) - 2
    for t in (0.8, 0.95):
        reps = sorted(set(best.values()))
        want = set()
        for i in reps:
            for j in reps:
                if rank(i) < rank(j) and _score(texts[i].lower().replace("!", ""), texts[j].lower().replace("!", "")) >= t:
                    want.add((i, j))
        links, members = nd.near_links(df, "t", "i", t, slice_rows=7)
        got = links.collect()
        assert len(got) == len(want) and {(r["loser"], r["winner"]) for r in got} == want
        assert {r["member"]: r["representative"] for r in members.collect()} == best


def test_near_pairs_hold_copies_and_members_of_classes(spark):
    """Every pair of rows that match, whichever row stands for their class; blank rows match nothing."""
    texts = _texts(random.Random(9), 6, 4)
    texts += [texts[8], texts[8].upper() + "!", texts[4] + " b", "", "!", "a", "A.", "a a", "a a a", *["x y z w"] * 5]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i long, t string")
    plain = [t.lower().replace("!", "").replace(".", "") for t in texts]
    for t in (0.8, 0.95):
        want = {(i, j) for j in range(len(texts)) for i in range(j) if plain[i] and plain[j] and _score(plain[i], plain[j]) >= t}
        got = [tuple(r) for r in nd.near_pairs(df, "t", "i", t, slice_rows=2).collect()]
        assert len(got) == len(want) and set(got) == want
    again = [tuple(r) for r in nd.near_pairs(df.union(df.where("i = 8")), "t", "i", 0.95).collect()]
    assert sorted(again) == sorted(p for p in want for _ in range(1 + (8 in p)))


def _judged(order, links):
    """Rows from best to worst; one linked to a kept row falls."""
    kept = set()
    for i in order:
        if not any(w in kept for w in links.get(i, ())):
            kept.add(i)
    return kept


def test_near_duplicates_fall_only_to_kept_rows(spark):
    chain = [[f"c{i}" for i in range(100)]]
    for i in range(30):  # each like the one before, less and less like the first
        chain.append([*chain[-1][:99], f"d{i}"] if i % 2 else [f"e{i}", *chain[-1][1:]])
        chain[-1][(7 * i) % 100] = f"f{i}"
    texts = _texts(random.Random(6), 12, 9) + [" ".join(c) for c in chain]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for t in (0.8, 0.93):
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        links = {i: [j for j in order[:at] if _score(texts[i], texts[j]) >= t] for at, i in enumerate(order)}
        got = {r["i"] for r in nd.remove_near_duplicates(df, "t", "i", t, slice_rows=20).collect()}
        assert got == _judged(order, links)
        fallen = set(range(len(texts))) - got
        assert any(set(links[i]) & fallen for i in got), "no row stays whose match falls"


def test_a_chain_is_settled_in_few_rounds(spark, monkeypatch):
    from querent.operators import independent as ip

    names = []
    plain = ip.materialize
    monkeypatch.setattr(ip, "materialize", lambda df, name: names.append(name) or plain(df, name))
    chain = spark.range(1, 1001).select(F.col("id").alias("loser"), (F.col("id") - 1).alias("winner"))
    fate = {r["row"]: r["stays"] for r in ip.first_independent_set(chain).collect()}
    assert fate == {i: i % 2 == 0 for i in range(1001)} and names.count("rows") <= 13


def test_independent_set_with_links_told_late(spark):
    from querent.operators import independent as ip

    rnd = random.Random(3)
    for n, most in ((60, 2), (60, 6), (200, 3)):
        links = {i: sorted(rnd.sample(range(i), min(i, rnd.randrange(most)))) for i in range(n)}
        every = spark.createDataFrame([(i, j) for i, js in links.items() for j in js], "loser long, winner long")
        first = spark.createDataFrame([(i, rnd.choice(js)) for i, js in links.items() if js], "loser long, winner long")
        want = _judged(range(n), links)
        open_rows = first.select(F.col("loser").alias("row")).distinct()
        late = ip.first_independent_set(first, open_rows, lambda rows: every.join(rows, every["loser"] == rows["row"], "left_semi"))
        for fate in (ip.first_independent_set(every), late):
            rows = fate.collect()
            assert len(rows) == len({r["row"] for r in rows})
            assert all(r["stays"] == (r["row"] in want) for r in rows)
            assert {r["row"] for r in rows if not r["stays"]} == set(range(n)) - want
    none = spark.createDataFrame([], "loser long, winner long")
    assert ip.first_independent_set(none).count() == 0


def test_cells_recall_and_exactness(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    points = centres[rng.integers(0, 8, 600)] + 0.3 * rng.normal(size=(600, 16))
    index = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[:20])], "query_id long, embedding array<double>")
    want = {i: set(np.argsort(-(points @ points[i]))[:5]) for i in range(20)}
    celled = vx.nearest_cells(index, centres)

    def recall(probes):
        got = {}
        for r in vx.top_k_cells(celled, queries, centres, 5, probes).collect():
            got.setdefault(r["query_id"], set()).add(r["chunk_id"])
        return np.mean([len(want[i] & got[i]) / 5 for i in range(20)])

    assert recall(8) == 1.0
    assert recall(2) > 0.8


def test_catalogue_and_documents(spark, tmp_path):
    root = tmp_path / "tree"
    for rel, body in {
        "题库/a.md": "# 题\r\n<!-- x -->\r\n\r\n\r\ntext ![i](u)", "top.TXT": "hi", "demo/skip.md": "no", "x/logs/l.md": "no",
        "HR/cv.pdf": "pdf", "pics/p.PNG": "png", "pics/p.gif": "gif", "x/简历/b.docx": "d",
    }.items():
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body.encode())
    files = fl.scan_files(spark, str(root))
    got = {r["name"]: r for r in files.collect()}
    assert set(got) == {"a.md", "top.TXT", "cv.pdf", "p.PNG", "b.docx"}
    assert got["top.TXT"]["category"] == "未分类" and got["a.md"]["category"] == "题库"
    assert got["p.PNG"]["needs_ocr"] and got["cv.pdf"]["is_template"] and got["b.docx"]["is_template"]
    docs = {r["file_name"]: r for r in fl.read_documents(spark, str(root), files).collect()}
    assert docs["a.md"]["full_text"] == "# 题\n\n\ntext ![i](u)".replace("\n\n\n", "\n\n")
    assert docs["a.md"]["pages"][0]["has_images"] and docs["top.TXT"]["full_text"] == "hi"


def test_bank_shapes(spark):
    shapes = [
        ["a", {"q": "b"}, {"n": 1}],
        {"questions": ["c"]},
        {"categories": [{"category": "K", "subcategories": [{"subcategory": "S", "questions": ["d"]}], "questions": ["e"]}]},
        {"categories": {"K": {"questions": ["f"]}, "L": ["g"], "questions": ["h"]}},
        {"M": {"questions": ["i"]}, "other": 3},
    ]
    df = spark.createDataFrame([(str(i), json.dumps(s)) for i, s in enumerate(shapes)], "file string, value string")
    got = sorted((r["file"], r["hint"] or "", r["text"]) for r in pb.raw_questions(df).collect())
    assert got == sorted([
        ("0", "", "a"), ("0", "", "b"), ("1", "", "c"), ("2", "K/S", "d"), ("2", "K", "e"), ("3", "K", "f"),
        ("3", "L", "g"), ("3", "questions", "h"), ("3", "categories", "h"), ("4", "M", "i"),
    ])


def test_bank_with_cleaner_batches(spark):
    raw = spark.createDataFrame(
        [("f_sql.json", None, i, f"{i}、 what is item {i % 5} about") for i in range(20)], "file string, hint string, pos long, text string")
    plain = pb.build_bank(raw)
    same = pb.build_bank(raw, lambda b: b.withColumn("output", F.concat(F.lit("```json\n"), "items_json", F.lit("\n```"))))
    rows = lambda b: sorted((r["question"], r["category"]) for r in b["unique"].collect())
    assert rows(plain) == rows(same) and len(rows(plain)) == 5
    assert pb.bank_report(plain).first().asDict() == {
        "raw_questions": 20, "removed_noise": 0, "cleaned": 20, "unique_questions": 5, "total_batches": 1}


def test_model_output(spark):
    outs = ['```json\n["a"]\n```', '{"questions": ["b"]}', 'so: ["c"] end', "[broken", '{"x": 1}']
    df = spark.createDataFrame([(o,) for o in outs], "o string")
    got = [r["x"] for r in df.select(F.transform(bk.parse_model_items(F.col("o")), bk.item_text).alias("x")).collect()]
    assert got == [["a"], ["b"], ["c"], [], []]


def test_upsert_moves_and_drops_partitions(spark):
    path, schema = scratch_path(spark, "t"), "k int, v int, d string"
    tb.write_table(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "b")], schema), path, "d")
    tb.upsert(spark, path, schema, spark.createDataFrame([(1, 2, "b"), (2, 0, "b")], schema), "k", "v", "d")
    assert sorted(map(tuple, tb.read_table(spark, path, schema).collect())) == [(1, 2, "b"), (2, 0, "b"), (3, 1, "b")]
    tb.delete_keys(spark, path, schema, spark.createDataFrame([(1,), (2,), (3,)], "k int"), "k", "d")
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_csv_quotes(spark):
    path = scratch_path(spark, "csv")
    sk.write_flat_bank(spark.createDataFrame([("c", ' say "hi", ok '), ("c", "  ")], "category string, question string"), path)
    assert {r["value"] for r in spark.read.text(path).collect()} == {"category,question", 'c,"say ""hi"", ok"'}


def test_rounded_scores(spark):
    df = spark.createDataFrame([(7.0, 5.0, 5.0)], "a double, b double, c double")
    total = sc.total_score(F.col("a"), F.col("b"), F.col("c"))
    row = df.select(total.alias("t"), sc.needs_followup(total).alias("f"), sc.apply_bias(F.col("a"), F.lit(9.0)).alias("b"),
                    sc.apply_bias(F.lit(12.0), F.lit(None).cast("double")).alias("n")).first()
    assert tuple(row) == (6.0, True, 10.0, 12.0)


def test_repair_round_replaces_chunks(spark):
    from querent.plans import corpus as pc

    rows = [("a", ".pdf", None), ("b", ".pdf", "  "), ("c", ".md", "Kept text of c."), ("d", ".pdf", "Kept text of d.")]
    docs = spark.createDataFrame(rows, "source_path string, file_type string, full_text string").withColumns(
        {"category": F.lit("x"), "markdown_text": F.lit(None).cast("string")})
    again = lambda r: r.select(
        "source_path", "file_type", F.when(F.col("source_path") == "a", "x" * 50 + " found again").alias("direct"),
        F.lit(None).cast("string").alias("fallback"))
    before = pc.parse_and_chunk(docs)
    stale = before.where("source_file = 'c'").withColumns({"source_file": F.lit("a"), "chunk_id": F.lit("old")})
    after = pc.repair_round(docs, [".pdf"], again, before.unionByName(stale))
    assert sorted(r["source_file"] for r in after["chunks"].collect()) == ["a", "c", "d"]
    assert after["chunks"].where("chunk_id = 'old'").count() == 0
    assert [r["original_path"] for r in after["queue"].collect()] == ["b"]
    # a round with nothing to repair changes nothing
    second = pc.repair_round(after["documents"], [".png"], again, after["chunks"])
    assert sorted(r["chunk_id"] for r in second["chunks"].collect()) == sorted(r["chunk_id"] for r in after["chunks"].collect())
