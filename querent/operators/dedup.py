"""Exact duplicate rules.

Groups of copies may hold a large part of a corpus, so no rule gathers a group:
the winner of a group comes from a partial aggregation and is joined back on
the unique row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once
from ..functions.text import dedup_normal, fingerprint, question_key
from ..session import materialize
from .ranking import first_seen, with_best_before


def with_fingerprint(df: DataFrame, text: str, name: str = "hash") -> DataFrame:
    return df.withColumn(name, fingerprint(F.col(text)))


_STEP = 1 << 64
_LAST = (1 << 63) - 1


def _rank(text: str, order: str) -> Column:
    """Longer is better; among equals the earlier row.

    One number, so that a hash aggregate can keep the greatest of a group.
    """
    wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    return F.length(text).cast("decimal(38,0)") * wide(_STEP) + (wide(_LAST) - F.col(order))


def keep_longest(df: DataFrame, text: str, order: str) -> DataFrame:
    """One row per normalised text: the longest, the first among equals.

    Only hash and rank are shuffled for the choice; ``order`` must be a unique
    integer, since survivors are joined back on it.
    """
    slim = df.select(fingerprint(F.col(text)).alias("hash"), _rank(text, order).alias("r"))
    place = F.lit(str(_LAST)).cast("decimal(38,0)") - F.col("r") % F.lit(str(_STEP)).cast("decimal(38,0)")
    winners = slim.groupBy("hash").agg(F.max("r").alias("r")).select(place.cast(df.schema[order].dataType).alias(order))
    return df.join(winners, order, "left_semi")


def winners_by_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """(winner, member, blank) of every row: the longest row of its normalised text, the first among equals; whether that text is empty."""
    slim = materialize(
        df.select(fingerprint(F.col(text)).alias("hash"), _rank(text, order).alias("r"), F.col(order).alias("member")), "hashes"
    )
    place = F.lit(str(_LAST)).cast("decimal(38,0)") - F.col("r") % F.lit(str(_STEP)).cast("decimal(38,0)")
    best = slim.groupBy("hash").agg(F.max("r").alias("r")).select("hash", place.cast(df.schema[order].dataType).alias("winner"))
    return slim.join(best, "hash").select("winner", "member", (F.col("hash") == F.md5(F.lit(""))).alias("blank"))


def duplicate_log(df: DataFrame, text: str, order: str) -> DataFrame:
    """(removed, kept) for every duplicate at the moment it was met.

    A longer newcomer replaces the row kept so far, which then is the removed
    one.
    """
    slim = materialize(
        df.select(F.col(order), fingerprint(F.col(text)).alias("hash"), F.length(text).alias("len")), "hashes"
    )
    rank = F.struct(F.col("len").alias("len"), (-F.col(order)).alias("neg"))
    met = with_best_before(slim, ["hash"], order, rank).where(F.col("best_before").isNotNull())
    other = -F.col("best_before.neg")
    longer = F.col("len") > F.col("best_before.len")
    return met.select(
        F.when(longer, other).otherwise(F.col(order)).alias("removed"),
        F.when(longer, F.col(order)).otherwise(other).alias("kept"),
    )


def across_files(df: DataFrame, text: str, source: str, key: str) -> DataFrame:
    """Rows whose text occurs in more than one file, as (source, key).

    Two different files per hash are visible from the least and the greatest
    file name, so no set of files is collected.
    """
    hashed = materialize(
        df.where(F.col(source).isNotNull()).select(source, key, fingerprint(F.col(text)).alias("hash")), "hashes"
    )
    shared = (
        hashed.groupBy("hash")
        .agg(F.min(source).alias("lo"), F.max(source).alias("hi"))
        .where("lo <> hi")
        .select("hash")
    )
    return hashed.join(shared, "hash", "left_semi").select(source, key)


def first_per_text(df: DataFrame, text: str, order: str) -> DataFrame:
    return first_seen(df, [text], order)


def first_per_question(df: DataFrame, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Questions by normal key: the first text of a key, and who repeated it.

    Returns (kept rows with their ``key``, (key, source) of later repeats).
    """
    keyed = materialize(once(df, key=question_key(F.col(text))).where("key <> ''"), "keyed")
    firsts = keyed.groupBy("key").agg(F.min(order).alias("_first"))
    marked = keyed.join(firsts, "key")
    kept = marked.where(F.col(order) == F.col("_first")).drop("_first")
    repeats = marked.where(F.col(order) > F.col("_first")).select("key", "source").distinct()
    return kept, repeats


__all__ = [
    "with_fingerprint", "keep_longest", "duplicate_log", "across_files",
    "first_per_text", "first_per_question", "dedup_normal",
]
