"""Quality measures and the validation record."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .arrays import bind
from .patterns import NORMAL_CHARS, SPACE_CHARS

GRAM_LENGTHS = (3, 5, 10)
# Normal characters of ASCII one by one: Java tests such a class in one look-up.
_PLAIN = "".join("\\" + ch if ch in "[]-&~" else ch for ch in (
    string.ascii_letters + string.digits + "_ \n\t,.!?;:'\"()[]{}<>-+*/=#@%&~`"))
_CHARS = 1 << 20


def _abnormal(c: Column) -> Column:
    """Characters outside the normal class: what is left without runs of it."""
    rest = F.regexp_replace(c, f"[{_PLAIN}]+", "")
    return F.length(F.regexp_replace(rest, f"[{NORMAL_CHARS}]+", ""))


def garbled_ratio(c: Column) -> Column:
    return bind(F.struct(F.length(c).alias("n"), _abnormal(c).alias("a")), lambda v: _garbled(v["n"], v["a"]))


def _garbled(n: Column, abnormal: Column) -> Column:
    return F.when(n > 0, F.lit(1.0) - (n - abnormal) / n).otherwise(0.0)


def special_ratio(c: Column) -> Column:
    return bind(F.struct(F.length(c).alias("n"), _abnormal(c).alias("a")), lambda v: _special(v["n"], v["a"]))


def _special(n: Column, abnormal: Column) -> Column:
    return F.when(n > 0, abnormal / n).otherwise(0.0)


def _equal_at(codes: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Positions whose character comes again ``step`` later in the same text."""
    same = np.zeros(len(codes), bool)
    np.equal(codes[step:], codes[:-step], out=same[:-step])
    for back in range(1, step + 1):
        same[(ends - back)[ends >= back]] = False
    return np.flatnonzero(same)


def _gram_length(text: str, twins: set[str], n: int) -> int:
    """Length taken by the first of the n-grams that comes thrice in all."""
    for at, gram in sorted((text.find(g), g) for g in twins):
        if at < len(text) - 2 * n and (count := text.count(gram)) > 2:
            return (count - 1) * n
    return 0


def _repeated(texts: list[str]) -> np.ndarray:
    """Characters taken by repetition in each text.

    Four for every run of five or more equal characters but line ends; and for
    each gram length the first n-gram that comes twice in a row and thrice in
    all.  Only n-grams directly before their own copy can qualify; they stand
    where n neighbours in a row equal the characters n further on, so all texts
    are compared with themselves at once.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) for t in texts])
    total = np.zeros(len(texts), np.int64)
    if not len(codes):
        return total
    at = _equal_at(codes, ends, 1)
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    runs = begins[begins + 3 < len(at)]
    first = at[runs[at[runs + 3] - at[runs] == 3]]
    np.add.at(total, np.searchsorted(ends, first[codes[first] != 10], "right"), 4)
    for n in GRAM_LENGTHS:
        if len(codes) <= n:
            continue
        at = _equal_at(codes, ends, n)
        twin = at[: 1 - n][at[n - 1:] - at[: 1 - n] == n - 1]
        found: dict[int, set[str]] = {}
        for i, pos in zip(np.searchsorted(ends, twin, "right").tolist(), twin.tolist(), strict=True):
            start = int(ends[i]) - len(texts[i])
            found.setdefault(i, set()).add(texts[i][pos - start: pos - start + n])
        for i, twins in found.items():
            total[i] += _gram_length(texts[i], twins, n)
    return total


@F.pandas_udf(DoubleType())
def _repetition(c: pd.Series) -> pd.Series:
    texts = c.fillna("").tolist()
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros(len(texts), np.int64)
    part = (np.cumsum(sizes) - sizes) // _CHARS  # texts of about a million characters are compared at once
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        total[begin:end] = _repeated(texts[begin:end])
    return pd.Series(np.where(sizes >= 20, np.minimum(total / np.maximum(sizes, 1), 1.0), 0.0))


def repetition_ratio(c: Column) -> Column:
    """Share of a text taken by runs and repeated n-grams; arrays inside tasks, a batch of rows at once."""
    return _repetition(F.make_valid_utf8(c))


def pair_issues(question: Column, answer: Column) -> Column:
    q = F.coalesce(question, F.lit(""))
    a = F.coalesce(answer, F.lit(""))
    return F.array_compact(
        F.array(
            F.when(q == "", "缺少问题").when(F.length(q) < 5, "问题过短"),
            F.when(a == "", "缺少答案").when(F.length(a) < 10, "答案过短"),
        )
    )


def _percent(c: Column) -> Column:
    """Two decimals, ties to the even digit."""
    return F.format_string("%.2f%%", F.bround(c * 100, 2))


def validate(
    content: Column,
    question: Column,
    answer: Column,
    chunk_type: Column,
    garbled_max: float = 0.3,
    repetition_max: float = 0.5,
    special_max: float = 0.3,
    min_length: int = 20,
) -> Column:
    """struct(is_valid, issues, overall, garbled_ratio, repetition_ratio, special_char_ratio).

    Blank content carries only the overall score 0.
    """
    none = F.expr("cast(array() as array<string>)")
    measured = F.struct(
        F.length(content).alias("n"), _abnormal(content).alias("a"), repetition_ratio(content).alias("r")
    )
    scored = lambda use: bind(measured, lambda v: bind(
        F.struct(v["n"].alias("n"), _garbled(v["n"], v["a"]).alias("g"), v["r"].alias("r"), _special(v["n"], v["a"]).alias("s")), use
    ))

    def with_issues(v: Column) -> Column:
        issues = F.concat(
            F.array_compact(
                F.array(
                    F.when(
                        v["n"] < min_length,
                        F.concat(F.lit("内容过短（"), v["n"].cast("string"), F.lit("字符）")),
                    ),
                    F.when(
                        v["g"] > garbled_max,
                        F.concat(F.lit("疑似乱码（非正常字符占比: "), _percent(v["g"]), F.lit("）")),
                    ),
                    F.when(
                        v["r"] > repetition_max,
                        F.concat(F.lit("大量重复内容（重复率: "), _percent(v["r"]), F.lit("）")),
                    ),
                    F.when(
                        v["s"] > special_max,
                        F.concat(F.lit("特殊字符过多（占比: "), _percent(v["s"]), F.lit("）")),
                    ),
                )
            ),
            F.when(chunk_type == "qa", pair_issues(question, answer)).otherwise(none),
        )
        return bind(
            issues,
            lambda i: bind(
                F.greatest(
                    F.lit(0.0),
                    F.least(
                        F.lit(1.0),
                        F.lit(1.0) - v["g"] * 0.5 - v["r"] * 0.3 - v["s"] * 0.2
                        - F.size(i) * F.lit(0.1),
                    ),
                ),
                lambda score: F.struct(
                    ((F.size(i) == 0) | (score >= 0.6)).alias("is_valid"),
                    i.alias("issues"),
                    score.alias("overall"),
                    v["g"].alias("garbled_ratio"),
                    v["r"].alias("repetition_ratio"),
                    v["s"].alias("special_char_ratio"),
                ),
            ),
        )

    no_score = F.lit(None).cast("double")
    blank = F.struct(
        F.lit(False).alias("is_valid"),
        F.array(F.lit("内容为空")).alias("issues"),
        F.lit(0.0).alias("overall"),
        no_score.alias("garbled_ratio"),
        no_score.alias("repetition_ratio"),
        no_score.alias("special_char_ratio"),
    )
    written = F.coalesce(content.rlike(f"[^{SPACE_CHARS}]"), F.lit(False))
    return F.when(~written, blank).otherwise(scored(with_issues))


def issue_kind(c: Column) -> Column:
    """Issue text with its numbers masked."""
    return F.regexp_replace(c, r"\d+\.?\d*%?", "X")
