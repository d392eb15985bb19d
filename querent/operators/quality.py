"""Quality report and review sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import issue_kind, validate
from ..functions.scores import exact_avg

_SORTED = 10_000
SCORES = ["overall", "garbled_ratio", "repetition_ratio", "special_char_ratio"]


def validate_chunks(chunks: DataFrame, remove_invalid: bool = False, **limits) -> DataFrame:
    """Chunks with their validation record flattened behind their own columns."""
    record = validate(
        F.col("content"), F.col("question"), F.col("answer"), F.col("chunk_type"), **limits
    )
    # Generated columns, so that a filter on them does not compute them again.
    checked = chunks.select("*", F.inline(F.array(record)))
    return checked.where("is_valid") if remove_invalid else checked


def score_summary(checked: DataFrame) -> DataFrame:
    """One row: totals and mean/min/max of every score; absent scores do not count."""
    aggs = [
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    ]
    for s in SCORES:
        aggs += [exact_avg(F.col(s)).alias(f"{s}_mean"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max")]
    return checked.agg(*aggs)


def issue_summary(checked: DataFrame) -> DataFrame:
    return (
        checked.select(F.explode("issues").alias("issue"))
        .select(issue_kind(F.col("issue")).alias("issue"))
        .groupBy("issue")
        .agg(F.count("*").alias("n"))
    )


def invalid_samples(checked: DataFrame, n: int = 20, order: str = "ord") -> DataFrame:
    return checked.where(~F.col("is_valid")).orderBy(order).limit(n)


def hash_take(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash, without one big sort.

    Rows are counted per hash prefix, four digits more in each round (at most
    65,536 counts reach the driver), and only inside the prefix that the n-th
    row falls into, until that holds at most ``_SORTED`` rows.  Prefixes that fit
    whole are kept by a filter; only the last one is sorted.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    taken, edge, digits = 0, "", 0
    while digits < 32:
        digits += 4
        prefix = F.substr("_h", F.lit(1), F.lit(digits))
        inside = hashed.where(F.col("_h").startswith(edge)) if edge else hashed
        counts = inside.groupBy(prefix.alias("p")).count().collect()
        for p, c in sorted((r["p"], r["count"]) for r in counts):
            if taken + c > n:
                edge = p
                break
            taken += c
        else:
            return df
        if c <= _SORTED:
            break
    prefix = F.substr("_h", F.lit(1), F.lit(digits))
    whole = hashed.where(prefix < edge)
    part = hashed.where(prefix == edge).orderBy("_h", key).limit(n - taken)
    return whole.unionByName(part).drop("_h")


def review_sample(df: DataFrame, key: str, ratio: float = 0.1, seed: str = "review") -> DataFrame:
    """max(1, int(n * ratio)) rows in seeded hash order; the same rows every run."""
    total = df.count()
    return hash_take(df, key, min(total, max(1, int(total * ratio))), seed)
