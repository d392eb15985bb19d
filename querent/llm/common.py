"""Helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first variant of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks_for(df: DataFrame, rows: int) -> int:
    """Number of blocks that hold about ``rows`` rows each."""
    return max(1, -(-df.count() // rows))


def prefix_sums(
    df: DataFrame, group: str, order: list[str], size: Column, out: str, blocks: int
) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before, within ``group``.

    A group of any size is cut into ``blocks`` by a hash of its order columns;
    only sums of blocks meet in one place.  Rows run by (block, order columns);
    rows equal in all of these are interchangeable.  ``group`` holds no nulls.
    """
    block, amount, base = (fresh(df, c) for c in ("_block", "_amount", "_base"))
    cut = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks))).withColumn(amount, size)
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(group, block).agg(F.sum(amount).alias(base))
        .withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    )
    inside = Window.partitionBy(group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, [group, block])
        .withColumn(out, F.col(base) + F.col(out))
        .drop(block, amount, base)
    )
