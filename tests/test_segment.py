"""Segmentation on hand-written texts, expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from querent.functions import segment as sg


def run(spark, text, fn):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(fn(F.col("t")).alias("x")).first()["x"]


def pairs(spark, text):
    return [(p["question"], p["answer"], p["question_num"]) for p in run(spark, text, sg.parse_pairs)]


def test_numbered_headings_and_steps(spark):
    text = "## 1. 什么是索引\n答：一种结构\n## 2、步骤一 建表\n写语句\n### 3 事务\n四个特性\n- 为什么？\n因为"
    assert pairs(spark, text) == [
        # the step heading is no question, so it stays in the answer above
        ("## 1. 什么是索引", "一种结构\n## 2、步骤一 建表\n写语句", 1),
        ("### 3 事务", "四个特性", 3),
        ("- 为什么？", "因为", None),
    ]


def test_offsets_cover_the_text(spark):
    text = "intro\n1. a?rest of line\nmore\n**2. b** tail\nQ3: c\nend"
    found = run(spark, text, sg.parse_pairs)
    assert [(p["question"], p["answer"]) for p in found] == [
        ("1. a?", "rest of line\nmore"), ("**2. b**", "tail"), ("Q3: c", "end"),
    ]
    assert [text[p["start_pos"]:p["end_pos"]] for p in found] == [
        "1. a?rest of line\nmore\n", "**2. b** tail\n", "Q3: c\nend",
    ]


def test_fenced_blocks(spark):
    text = "## Reverse a list 7\n```python\nxs[::-1]\n```\n\n## Sum\n```\nsum(xs)\n```"
    found = run(spark, text, lambda c: sg.pairs_by_code(sg.normalise_document(c)))
    assert [(p["question"], p["answer"], p["question_num"]) for p in found] == [
        ("## Reverse a list 7", "xs[::-1]", 7), ("## Sum", "sum(xs)", None),
    ]
    assert text[found[1]["start_pos"]:found[1]["end_pos"]] == "## Sum\n```\nsum(xs)\n```"


def test_paragraph_strategy_is_the_last(spark):
    text = "why so\nreally?\n\nfirst\n\nsecond\n\nand\nthen？\n\nthird"
    assert pairs(spark, text) == [("why so\nreally?", "first\n\nsecond", None), ("and\nthen？", "third", None)]


def test_merge_short(spark):
    text = "Q1: a\nb\nQ2: c\nd\nQ3: " + "long " * 20 + "\nend"
    merged = run(spark, text, lambda c: sg.merge_short_pairs(sg.parse_pairs(c), 15))
    assert [m["question"] for m in merged] == ["Q1: a", "Q3: " + ("long " * 20).strip()]
    assert merged[0]["answer"] == "b\n\nQ2: c\nd"
    assert merged[0]["end_pos"] == merged[1]["start_pos"]


def test_long_pair_is_split_with_overlap(spark):
    answer = "\n\n".join(["p1 " + "x" * 60, "tail one. tail two.", "p3 " + "y" * 80])
    text = "Q: q\n" + answer
    chunks = run(spark, text, lambda c: sg.chunk_pairs(sg.parse_pairs(c), 100, 30))
    assert [c["part"] for c in chunks] == [1, 2]
    assert chunks[0]["content"] == "Q: q\n\np1 " + "x" * 60 + "\n\ntail one. tail two."
    assert chunks[1]["content"] == "Q: q\n\n（续）\n\ntail one. tail two.p3 " + "y" * 80
    assert all(c["is_split"] for c in chunks)


def test_overlap_prefers_sentences(spark):
    part = "a" * 40 + "。bb。cc"
    assert run(spark, part, lambda c: sg.overlap_text(c, 10)) == "bb。cc。"
    assert run(spark, "z" * 50, lambda c: sg.overlap_text(c, 10)) == "z" * 10


def test_markdown_sections(spark):
    text = "intro\n# T1\n\nbody one\n## Step 2\nmore\n# Empty\n# T2\n" + "s. " * 40
    got = [(c["md_title"], c["content"], c["force_split"]) for c in run(spark, text, lambda c: sg.chunk_markdown(c, 60, 10))]
    assert got[:3] == [(None, "intro", None), ("# T1", "# T1\n\nbody one", None), ("## Step 2", "## Step 2\n\nmore", None)]
    assert all(t == "# T2" and f for t, _, f in got[3:]) and len(got) > 4
    # for extraction a step heading belongs to the section above
    assert run(spark, text, lambda c: sg.split_sections(c, 60))[:2] == ["intro", "# T1\n\nbody one\n## Step 2\nmore"]


@pytest.mark.parametrize("size,overlap", [(60, 10), (100, 20)])
def test_forced_windows_against_a_plain_loop(spark, size, overlap):
    import random

    rnd = random.Random(size)
    texts = ["".join(rnd.choice("ab .\n!") for _ in range(n)) for n in (0, 1, size, size + 1, 7 * size, 1000)]
    texts.append("x" * 333)

    def loop(t):
        out, start = [], 0
        while start < len(t):
            end = start + size
            if end < len(t):
                marks = [i for i in range(start + size // 2 + 1, end + 1) if t[i] in "。！？.!?\n"]
                end = marks[-1] + 1 if marks else end
            out.append(t[start:end].strip())
            start = end - overlap if end < len(t) else end
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", sg.force_split(F.col("t"), size, overlap).alias("x")).collect()}
    for t in texts:
        assert got[t] == loop(t)


def test_plain_chunks_cover_every_word(spark):
    words = [f"w{i}" for i in range(800)]
    text = "\n\n".join(" ".join(words[i:i + 37]) for i in range(0, 800, 37))
    joined = " ".join(c["content"] for c in run(spark, text, lambda c: sg.chunk_plain(c, 400, 50)))
    assert set(words) <= set(joined.split())
