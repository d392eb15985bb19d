"""Order-dependent work inside groups of any size.

A plain window puts a whole group into one task.  Here all rows are dealt out by
ranges of (group, order, tie), so a large group spans several parts, equal order
values included; each part is handled by itself, and only one summary row per
group and part meets in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    """``df`` with ``_b``: its part along the order of every group.

    Written before and after: ranges are drawn from a sample, for which all that
    makes the rows would run a second time, and a plan computed twice might cut
    differently.  Rows equal in all order columns are told apart by where they
    came from, which lets them be cut too.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = materialize(df.withColumn("_s", F.monotonically_increasing_id()), "unranged")
    dealt = made.repartitionByRange(n, *keys, *order, "_s")
    return materialize(dealt.withColumn("_b", F.spark_partition_id()).drop("_s"), "ranged")


def _carry(ranged: DataFrame, keys: list[str], per_part: Column, before: Column) -> tuple[DataFrame, Column]:
    """(keys, part, _carry): what the earlier parts of a group hand on."""
    window = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*keys, "_b").agg(per_part.alias("_part")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_ob"),
        before.over(window).alias("_carry"),
    )
    same = F.col("_b") == F.col("_ob")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return carried, same


def with_ordinal(
    df: DataFrame, keys: list[str], order: str, tie: str | None = None, name: str = "ordinal",
    parts: int | None = None,
) -> DataFrame:
    """1-based position of every row inside its group."""
    ordering = [order] + ([tie] if tie else [])
    ranged = _ranged(df, keys, ordering, parts)
    carried, same = _carry(ranged, keys, F.count("*"), F.sum("_part"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*ordering))
    return (
        ranged.withColumn("_r", inside).join(carried, same)
        .withColumn(name, F.col("_r") + F.coalesce("_carry", F.lit(0)))
        .select(*df.columns, name)
    )


def with_best_before(
    df: DataFrame, keys: list[str], order: str, rank: Column, name: str = "best_before", parts: int | None = None,
) -> DataFrame:
    """Greatest ``rank`` among the earlier rows of the group, null for the first."""
    ranged = _ranged(df.withColumn("_rank", rank), keys, [order], parts)
    carried, same = _carry(ranged, keys, F.max("_rank"), F.max("_part"))
    inside = F.max("_rank").over(
        Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_in", inside).join(carried, same)
        .withColumn(name, F.greatest("_in", "_carry"))
        .select(*df.columns, name)
    )


def _first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per group; Spark drops later ones before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row per group; a null order counts as the earliest."""
    return _first_row(df, keys, [F.desc(c) for c in order])


def first_seen(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row per group by the given order, nulls first."""
    return _first_row(df, keys, [F.asc(c) for c in order])


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """First ``k`` rows per group; Spark limits each group before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)
