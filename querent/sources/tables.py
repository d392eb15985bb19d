"""Stored tables: append, upsert, cascade delete, ordered read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import latest
from ..session import scratch_path


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file (or folder of files) that holds one JSON array of records.

    Fields the schema does not name, such as a derived length, are ignored.
    """
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` in the layout of a stored table: its columns in order, cast, null where missing."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ])


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> None:
    """Write rows; partitioned ones are first brought together by partition, large ones split."""
    if partition is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", partition).write.mode(mode).partitionBy(partition).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _replace_partitions(spark, new: DataFrame, path: str, partition: str, touched: set) -> None:
    """Put ``new`` in place of the touched partitions.

    The rows come partly from ``path`` itself, so they are staged first; a
    partition left without rows loses its folder.  Files of one partition change
    together, several partitions one after the other: run the same call again
    after a failure.
    """
    staged = scratch_path(spark, "staged")
    new.write.parquet(staged)
    new = spark.read.schema(new.schema).parquet(staged)
    left = set(_partitions_of(new, partition))
    (
        new.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    for value in touched - left:
        drop_partition(spark, path, partition, value)
    drop_path(spark, staged)


def _partitions_of(df: DataFrame, partition: str) -> list:
    """Distinct partition values: as many as there are folders, not rows."""
    return [r[0] for r in df.select(partition).distinct().collect()]


def _in_partitions(partition: str, values: set):
    named = F.coalesce(F.col(partition).isin(*[v for v in values if v is not None]), F.lit(False))
    return named | F.col(partition).isNull() if None in values else named


def upsert(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, version: str, partition: str) -> None:
    """Insert or replace by ``key``: an incoming row always replaces the stored one.

    ``version`` decides between incoming rows of one key.  Only partitions that
    get a new row or lose an old one are rewritten; a null partition is one like
    any other.
    """
    current = read_table(spark, path, schema)
    moved = current.join(updates.select(key).distinct(), key, "left_semi")
    touched = set(_partitions_of(updates, partition)) | set(_partitions_of(moved, partition))
    old = current.where(_in_partitions(partition, touched))
    both = old.withColumn("_incoming", F.lit(0)).unionByName(updates.withColumn("_incoming", F.lit(1)))
    merged = latest(both, [key], "_incoming", version).drop("_incoming")
    _replace_partitions(spark, merged, path, partition, touched)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_partition(spark: SparkSession, path: str, partition: str, value) -> None:
    """Remove the folder of a partition that has lost its last row."""
    drop_path(spark, f"{path}/{partition}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")


def delete_keys(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str, partition: str) -> None:
    """Delete all rows of the keys, rewriting only partitions that hold one."""
    current = read_table(spark, path, schema)
    hit = set(_partitions_of(current.join(keys, key, "left_semi"), partition))
    if not hit:
        return
    rest = current.where(_in_partitions(partition, hit)).join(keys, key, "left_anti")
    _replace_partitions(spark, rest, path, partition, hit)


def cascade_delete(spark: SparkSession, tables: dict[str, str], keys: DataFrame, key: str = "session_id", partition: str = "session_date") -> None:
    """Delete the keys from every table given as path -> schema."""
    for path, schema in tables.items():
        delete_keys(spark, path, schema, keys, key, partition)
