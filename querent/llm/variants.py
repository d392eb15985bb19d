"""Spelling variants of words: candidates by PartEnum signatures, verified.

A word is the multiset of its letters, seen as a binary vector with an element
(letter, how many-eth).  One inserted, deleted or replaced letter changes at most
two elements, so words that are near have vectors at a Hamming distance of two
or less.  The elements are dealt to six parts; two vectors that differ in two
elements agree on four whole parts at least, so each of the fifteen choices of
four parts gives a signature, and near words share one of them.  Signatures are
joined as equal keys and every candidate is verified, so nothing is missed and
nothing wrong is kept; a word has fifteen signatures whatever its length.

Occurrences become (word, count) before anything is joined: frequent words, hot
sources and groups of copies weigh as much as a single word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..session import materialize
from .manifest import lower_case

RUN = r"[A-Za-zÀ-ÿ]+"
PARTS = 6
DISTANCE = 2
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many loses a letter, by the contract's hash.
MISSPELT = 97


def occurrences(docs: DataFrame) -> DataFrame:
    """``word``: every run of letters, A-Z lower-cased, one in 97 without one letter.

    A null text has no runs; a null doc_id is hashed as an empty one.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_case(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % MISSPELT == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words long and frequent enough."""
    return (
        words.where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def _parts(word: Column, parts: int) -> Column:
    """For each part, what the word's multiset has in it.

    Element (letter, j) lies in part (code + j) mod ``parts``; a letter that
    occurs m times has m // parts elements in each part and one more in the
    m % parts that follow its code, so no element is listed.
    """
    ordered = F.array_join(F.array_sort(F.split(word, "")), "")
    letters = F.transform(
        F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0)),
        lambda run: F.struct(F.substring(run, 1, 1).alias("c"), F.length(run).alias("m")),
    )

    def of_part(all_: Column, p: int) -> Column:
        number = lambda x: F.floor(x["m"] / parts) + (
            F.pmod(F.lit(p) - F.ascii(x["c"]), F.lit(parts)) < x["m"] % parts
        ).cast("long")
        held = F.filter(F.transform(all_, lambda x: F.struct(x["c"].alias("c"), number(x).alias("m"))), lambda x: x["m"] > 0)
        return F.array_join(F.transform(held, lambda x: F.concat(x["c"], x["m"].cast("string"))), "")

    return bind(letters, lambda all_: F.array(*[of_part(all_, p) for p in range(parts)]))


def signatures(words: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """``word`` with each of its signatures: a choice of all parts but ``distance``, and what the word has there."""
    kept = list(combinations(range(parts), parts - distance))
    each = F.col("parts")
    keys = F.array(*[F.xxhash64(F.lit(i), *[each[p] for p in some]) for i, some in enumerate(kept)])
    return words.withColumn("parts", F.explode(F.array(_parts(F.col("word"), parts)))).select(
        *words.columns, F.explode(keys).alias("signature")
    )


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``words`` (distinct ``word``), a < b, one letter inserted, deleted or replaced apart."""
    signed = materialize(signatures(words.select("word", F.length("word").alias("size"))), "signatures")
    a, b = (signed.select("signature", F.col("word").alias(w), F.col("size").alias(f"{w}_size")) for w in "ab")
    return (
        a.join(b, "signature").where("a < b and abs(a_size - b_size) <= 1")
        .where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    )


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` of every ``word`` that has a ``form``: the end of its chain of forms.

    Chains have no loops.  Pointers double in each round, so the rounds grow
    with the logarithm of the longest chain; each is written, so lineage does
    not grow.
    """
    now = materialize(links.select("word", F.col("form").alias("root")), "pointers")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = materialize(
            now.join(ahead, "root", "left")
            .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")),
            "pointers",
        )
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (word, n).

    The form of a word is its near word of largest ``n``, of ties the first in
    code points, if that is at least twice the word's ``n``.  Words without near
    words have 0 of them, no form, and are their own root.
    """
    pairs = materialize(near_words(words), "near-words")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = (
        both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    )
    strong = -F.col("best.less") >= 2 * F.col("n")
    named = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(named.where("form is not null").select("word", "form"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all of ``docs``.

    Null and empty texts have no words, an empty table gives no rows; repeated
    rows count each time, since the contract counts occurrences.  A run of
    letters of any length is one word, and texts of any length are cut whole.
    Only doc_id and text are read.
    """
    return group_variants(materialize(vocabulary(occurrences(docs.select("doc_id", "text"))), "vocabulary"))
