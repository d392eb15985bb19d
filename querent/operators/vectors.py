"""Vector index: embedding, append, exact and cell-pruned top-k.

The heavy step, scores of a block of queries against a block of the index, is a
matrix product on Arrow data: every pair of blocks is a row of a join, and a task hands
on at most k rows per query.  Neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, path_exists
from .catalog import new_rows
from .ranking import first_seen

# Queries of this size travel to every task; beyond it blocks of both sides are dealt out in pairs.
QUERY_BLOCK_BYTES = 8 * 1024 * 1024
# Rows of a block: two blocks and their scores are what a task holds.
BLOCK_ROWS = 2048
# Rows found that a task holds before it hands them on.
HELD_ROWS = 1 << 22
# Products of matrices may differ from sums by row in the last digits.
_SLACK = 1e-9


# --- build ------------------------------------------------------------------------
def embed(rows: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 100) -> DataFrame:
    """Rows with an L2-normalised ``embedding``.

    ``encoder`` is called once per worker process and returns a function from a
    list of texts to a matrix.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            parts = [
                np.asarray(model(texts.iloc[i : i + batch].tolist()), dtype=np.float64)
                for i in range(0, len(texts), batch)
            ]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 0))
            yield pd.Series(list(matrix), index=texts.index)

    return rows.withColumn("embedding", normalise(encode(F.col(text))).cast("array<float>"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    from ..functions.arrays import bind

    return bind(
        F.struct(v.alias("v"), norm(v).alias("n")),
        lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]),
    )


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunk rows as the index stores them: no nulls in the flat fields, lists
    as JSON text."""
    out = chunks
    for c in ("question", "answer", "source_file"):
        if c in chunks.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    if "question_num" in chunks.columns:
        out = out.withColumn("question_num", F.coalesce("question_num", F.lit(0)))
    for f in chunks.schema.fields:
        if f.dataType.typeName() == "array" and f.name != "embedding":
            out = out.withColumn(f.name, F.to_json(f.name))
    kept = [
        f.name for f in out.schema.fields
        if f.name == "embedding" or f.dataType.typeName() not in ("map", "struct", "array")
    ]
    return out.select(*kept)


def append_new(
    chunks: DataFrame, path: str, key: str = "chunk_id", prepare: Callable[[DataFrame], DataFrame] = index_rows
) -> None:
    """Append the chunks the index does not hold; running twice adds nothing.

    ``prepare`` makes index rows of chunks.  It sees only what is new, so a
    model called there is called once per chunk.
    """
    spark = chunks.sparkSession
    others = F.to_json(F.struct(*[c for c in chunks.columns if c != key], F.lit(0)))
    fresh = chunks.withColumn("_tie", F.xxhash64(others))
    fresh = first_seen(fresh, [key], "_tie").drop("_tie")
    if path_exists(spark, path):
        fresh = new_rows(fresh, spark.read.parquet(path), key)
    prepare(fresh).write.mode("append").parquet(path)


def get_by_ids(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index rows of the given ids."""
    return index.join(ids.select(key), key, "left_semi")


def clear_index(spark: SparkSession, path: str) -> None:
    """Delete all rows; the index stays readable and empty."""
    if path_exists(spark, path):
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def dimension_report(index: DataFrame, dim: int) -> DataFrame:
    """Rows per width, with a flag whether it is the encoder's."""
    width = F.size("embedding")
    return index.groupBy(width.alias("width")).agg(F.count("*").alias("n")).withColumn("fits", F.col("width") == dim)


def check_dimension(index: DataFrame, dim: int) -> None:
    wrong = index.where(F.size("embedding") != dim).limit(1).count()
    if wrong:
        raise ValueError(f"index holds vectors whose width is not {dim}")


def metadata_filter(**conditions) -> Column | None:
    """Equality conditions joined by AND; None without any."""
    out = None
    for name, value in conditions.items():
        if value is not None:
            test = F.col(name) == value
            out = test if out is None else out & test
    return out


# --- search -----------------------------------------------------------------------------
def _best(matrix: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row numbers, and scores, of all that can be among the k best per query; ``least`` are the scores to reach.

    The matrix product picks who can be among the k; these are scored again row
    by row, so that equal vectors get equal scores.
    """
    scores = matrix @ vectors.T
    if scores.shape[1] > k and np.isneginf(least).any():
        least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
    least = np.where(np.isneginf(least), least, least - _SLACK * np.maximum(1.0, np.abs(least)))
    rows, cols = np.nonzero((scores >= least[:, None]) | np.isneginf(least)[:, None])
    return rows, cols, (matrix[rows] * vectors[cols]).sum(axis=1)


def _merged(who: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best per query, ties by id, queries in order."""
    order = np.lexsort((ids, -scores, who))
    first = np.searchsorted(who[order], who[order])
    return order[np.arange(len(order)) - first < k]


def _pack(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """``key, rows``: rows of a key that stand together, in arrays of up to ``block_rows``; nothing is shuffled."""
    import pyarrow as pa

    kept = [f for f in rows.schema.fields if f.name != key]
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            body = pa.StructArray.from_arrays([batch.column(f.name) for f in kept], names=[f.name for f in kept])
            for run in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                for i in range(0, len(run), block_rows):
                    part = run[i : i + block_rows]
                    held = pa.ListArray.from_arrays([0, len(part)], body.take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part[:1]], pa.int64()), held], names=[key, "rows"])

    return rows.withColumn(key, F.col(key).cast("long")).mapInArrow(pack, f"`{key}` long, rows array<struct<{fields}>>")


def _matrix(rows) -> np.ndarray:
    """The embeddings of a packed block."""
    held = rows.field("embedding")
    return held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)


def _block_pairs(pairs: DataFrame, k: int, id_col: str, keep: list[str]) -> DataFrame:
    """The k best of all packed blocks (``rows``) that stand in one task beside a packed block of ``queries`` (``block``), for each of its queries.

    What has been found for a query is held, and later rows must reach its k-th
    score; it is handed on at the end, or when a task holds too much.
    """
    import pyarrow as pa

    names = [id_col, *[c for c in keep if c != id_col]]
    types = {f.name: f.dataType.simpleString() for f in pairs.schema["rows"].dataType.elementType.fields}
    q_type = pairs.schema["queries"].dataType.elementType["query_id"].dataType.simpleString()
    ddl = f"query_id {q_type}, score double, " + ", ".join(f"`{c}` {types[c]}" for c in names)

    def out(asked, least, who, scores, found):
        return pa.RecordBatch.from_arrays([asked.take(pa.array(who)), pa.array(scores), *found], names=["query_id", "score", *names])

    def best(batches):
        held: dict[int, tuple] = {}
        total = 0
        for batch in batches:
            for i in range(batch.num_rows):
                rows, queries = (batch.column(c).slice(i, 1).flatten() for c in ("rows", "queries"))
                block = batch.column("block")[i].as_py()
                if block not in held:
                    # copied, so that nothing holds on to the batch
                    asked, none = queries.field("query_id").take(pa.array(np.arange(len(queries)))), pa.array([], pa.int64())
                    held[block] = (asked, np.full(len(asked), -np.inf), np.zeros(0, int), np.zeros(0), [rows.field(c).take(none) for c in names])
                asked, least, *old = held[block]
                who, cols, scores = _best(_matrix(queries), _matrix(rows), k, least)
                if not len(who):
                    continue
                found = [pa.concat_arrays([x, rows.field(c).take(pa.array(cols))]) for x, c in zip(old[2], names)]
                who, scores = np.concatenate([old[0], who]), np.concatenate([old[1], scores])
                kept = _merged(who, scores, found[0].to_numpy(zero_copy_only=False), k)
                who, scores = who[kept], scores[kept]
                last = np.searchsorted(who, np.arange(len(asked)), "right") - 1
                full = np.bincount(who, minlength=len(asked)) == k
                held[block] = (asked, np.where(full, scores[last], -np.inf), who, scores, [c.take(pa.array(kept)) for c in found])
                total += len(who) - len(old[0])
                if total > HELD_ROWS:
                    yield from (out(*x) for x in held.values())
                    held, total = {}, 0
        yield from (out(*x) for x in held.values())

    return pairs.mapInArrow(best, ddl).select("query_id", id_col, "score", *names[1:])


def _final(found: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(
    index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", keep: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact inner-product top-k for all queries at once; ranks go by unrounded scores.

    ``queries`` has query_id and embedding and may be as large as the index: both
    sides are cut into blocks, every pair of blocks meets in one row, and a task
    holds one pair and what it has found.  Queries of one bounded block travel to
    the index.  Beyond it the blocks of both sides are written once and read by
    pairs of partitions, so that neither is shuffled; the index is then cut into
    no more partitions than keep the cores at work, since each of them hands on
    k rows per query.
    """
    queries = queries.select("query_id", "embedding")
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")) * 8, F.lit(0))).first()
    small = size <= QUERY_BLOCK_BYTES
    asked = _pack((queries.repartition(max(1, -(-n // block_rows))) if small else queries).withColumn("_key", F.spark_partition_id()), "_key", block_rows)
    asked = asked.select(F.monotonically_increasing_id().alias("block"), F.col("rows").alias("queries"))
    held = _pack(
        index.select(*dict.fromkeys([id_col, "embedding", *(keep or [])])).withColumn("_part", F.spark_partition_id()), "_part", block_rows
    ).select("rows")
    if small:
        pairs = held.crossJoin(F.broadcast(asked))
    else:
        asked, held = materialize(asked, "query-blocks"), materialize(held, "index-blocks")
        cores = index.sparkSession.sparkContext.defaultParallelism
        parts = -(-2 * cores // max(1, asked.rdd.getNumPartitions()))
        pairs = held.coalesce(parts).hint("shuffle_replicate_nl").crossJoin(asked)
    return _final(_block_pairs(pairs, k, id_col, keep or []), k, id_col)


def top_k_cosine(index: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, **options) -> DataFrame:
    """Cosine top-k among the rows that pass ``where``."""
    rows = index if where is None else index.where(where)
    return top_k(
        rows.withColumn("embedding", normalise(F.col("embedding"))),
        queries.withColumn("embedding", normalise(F.col("embedding"))),
        k, **options,
    )


def top_k_postfilter(index: DataFrame, queries: DataFrame, k: int, where: Column, keep: list[str], id_col: str = "chunk_id") -> DataFrame:
    """Take 2k, drop what fails ``where``, keep the first k: may give fewer."""
    wide = top_k(index, queries, 2 * k, id_col, keep).drop("rank").where(where)
    return _final(wide, k, id_col)


# --- cells: approximate search on large indexes -------------------------------------------
def train_cells(index: DataFrame, n: int, rounds: int = 10, sample_rows: int = 50_000, id_col: str = "chunk_id") -> np.ndarray:
    """Centres of ``n`` cells: k-means on the ``sample_rows`` rows of smallest hashed id.

    The sample bounds what the driver holds; every row is put into a cell by
    ``nearest_cells`` whatever the sample was.
    """
    rows = index.select(id_col, "embedding").orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()
    points = np.array([r["embedding"] for r in rows], dtype=np.float64)
    centres = points[: min(n, len(points))].copy()
    for _ in range(rounds):
        own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, n: int = 1, name: str = "cell") -> DataFrame:
    """Number(s) of the nearest centres per vector; the centres are a small matrix."""
    centres = np.asarray(centres, dtype=np.float64)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=object)
        scores = np.stack(v.to_numpy()).astype(np.float64) @ centres.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return pd.Series(list(order.astype(np.int32)))

    out = cells(F.col("embedding"))
    return vectors.withColumn(name, F.get(out, F.lit(0)) if n == 1 else out)


def top_k_cells(
    index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 4, id_col: str = "chunk_id",
    keep: list[str] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k among the ``probes`` cells nearest to each query.

    ``index`` carries a ``cell`` column; stored partitioned by it, only probed
    folders are read.  With as many probes as centres the result is exact.
    Queries are dealt to their cells and meet the blocks of these.
    """
    celled = nearest_cells(queries.select("query_id", "embedding"), centres, max(2, probes), "cells")
    near = celled.select("query_id", "embedding", F.explode(F.slice("cells", 1, probes)).alias("cell"))
    asked = _pack(near.repartition("cell"), "cell", block_rows).withColumnRenamed("rows", "queries").withColumn("block", F.monotonically_increasing_id())
    held = _pack(index.select(*dict.fromkeys([id_col, "embedding", *(keep or []), "cell"])), "cell", block_rows)
    return _final(_block_pairs(held.join(asked, "cell"), k, id_col, keep or []), k, id_col)


# --- hits ----------------------------------------------------------------------------------
def hits_to_questions(hits: DataFrame) -> DataFrame:
    """Question rows from hits: question text or else content, one per chunk."""
    from ..functions.labels import job_category
    from ..functions.text import strip

    blank = F.lit("")
    text = F.coalesce(
        F.nullif(strip(F.coalesce("question", blank)), blank), strip(F.coalesce("content", blank))
    )
    rows = hits.select(
        F.col("chunk_id").alias("question_id"),
        text.alias("content"),
        strip(F.coalesce("answer", blank)).alias("reference_answer"),
        F.lit("概念题").alias("question_type"),
        F.lit("进阶").alias("difficulty"),
        job_category(F.col("source_file")).alias("job_category"),
    ).where("content <> ''")
    return first_seen(rows, ["question_id"], "content", "reference_answer", "job_category")
