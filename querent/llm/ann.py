"""Approximate nearest neighbours from stable projections in a kd-tree.

Unit vectors are projected by a Gaussian (2-stable) matrix to a few dimensions,
where a kd-tree orders them.  A query takes leaves by their projected distance
and verifies their vectors; the squared projected distance of a vector at
distance ``d`` is ``d**2`` times a chi-square variable, so once the next leaf is
so far that a closer neighbour would lie there with probability ``1 - sure`` at
most, the search ends.

The index is a table of blocks, written once.  Query batches of bounded size go
to the blocks; a block answers with its best few, and those meet by query.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DIMENSIONS = 8
SURE = 0.98
LEAF = 64
BLOCK_ROWS = 8_192
BATCH = 4_096
NEIGHBOURS = "query_id long, vec_id long, score double"


def usable(embedding: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def projection(width: int, seed: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dimensions))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of ``points`` in leaves of at most ``leaf``, halved at the median of the widest side."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        own = points[rows]
        half = len(rows) // 2
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves


def chi_square_quantile(p: float, dimensions: int) -> float:
    """Value below which a chi-square variable of an even number of degrees lies with probability ``p``."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def _build(seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        ids = rows["vec_id"].to_numpy(np.int64)
        points = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ projection(vectors.shape[1], seed)
        leaves = kd_leaves(points)
        order = np.concatenate(leaves)
        out = io.BytesIO()
        np.savez(
            out, ids=ids[order], vectors=vectors[order],
            low=np.stack([points[x].min(0) for x in leaves]), high=np.stack([points[x].max(0) for x in leaves]),
            ends=np.cumsum([len(x) for x in leaves]),
        )
        return pd.DataFrame({"width": [int(key[0])], "block": [out.getvalue()]})

    return run


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """Table ``width, block`` over the usable rows of ``vectors`` (vec_id, embedding) with an id."""
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    )
    blocks = max(1, -(-good.count() // block_rows))
    dealt = good.select(
        "vec_id", "embedding", F.size("embedding").alias("width"),
        F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("part"),
    )
    return materialize(dealt.groupBy("width", "part").applyInPandas(_build(seed), "width int, block binary"), "kd-index")


def search_block(
    block: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, matrix: np.ndarray, k: int, limit: float
) -> Iterator[tuple[int, int, float]]:
    """The best ``k`` of a block for each query but for rows of the query's own id."""
    vectors = block["vectors"]
    norms = np.sqrt((vectors * vectors).sum(1))
    units = vectors / norms[:, None]
    starts = np.concatenate(([0], block["ends"][:-1]))
    for own, vector in zip(ids, queries, strict=True):
        length = np.sqrt((vector * vector).sum())
        unit = vector / length
        point = unit @ matrix
        away = np.maximum(np.maximum(block["low"] - point, point - block["high"]), 0)
        away = np.sqrt((away * away).sum(1))
        order = np.argsort(away, kind="stable")
        seen, near = [], []
        best = np.empty(0)
        step, at = 4, 0
        while at < len(order):
            # what is this close cannot be told from the query's own place by rounding
            if len(best) == k and max(away[order[at]] - 1e-6, 0.0) ** 2 > limit * max(2 - 2 * best.min(), 0.0):
                break
            rows = np.concatenate([np.arange(starts[x], block["ends"][x]) for x in order[at : at + step]])
            rows = rows[block["ids"][rows] != own]
            cosines = units[rows] @ unit
            seen.append(rows)
            near.append(cosines)
            best = np.concatenate([best, cosines])
            if len(best) > k:
                best = np.partition(best, len(best) - k)[-k:]
            at += step
            step *= 2
        if not len(best):
            continue
        rows, cosines = np.concatenate(seen), np.concatenate(near)
        rows = rows[cosines >= best.min() - 1e-9]
        exact = (vectors[rows] * vector).sum(1) / (norms[rows] * length)
        for i in np.lexsort((block["ids"][rows], -exact))[:k]:
            yield int(own), int(block["ids"][rows[i]]), float(exact[i])


def nearest(
    index: DataFrame, queries: DataFrame, k: int = 5, seed: int = 0, sure: float = SURE, batch: int = BATCH
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of largest cosine found.

    Queries (vec_id, embedding) that share an id count once, by their smallest
    vector; unusable ones and those without id get no rows.  Only vectors of a
    query's own length are candidates, none with the query's id.  Ties go to the
    smaller vec_id; a repeated vec_id is a candidate as often as it is indexed.
    """
    spark = index.sparkSession
    asked = materialize(
        queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding")),
        "queries",
    )
    limit = chi_square_quantile(sure, DIMENSIONS)

    def answers(part: pd.DataFrame) -> DataFrame:
        by_width = {
            int(w): (g["vec_id"].to_numpy(np.int64), np.stack(g["embedding"].to_numpy()).astype(np.float64))
            for w, g in part.groupby(part["embedding"].map(len))
        }
        shared = spark.sparkContext.broadcast(by_width)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for width, payload in zip(rows["width"], rows["block"], strict=True):
                    if width in shared.value:
                        ids, vectors = shared.value[width]
                        block = dict(np.load(io.BytesIO(payload)))
                        yield pd.DataFrame(
                            list(search_block(block, ids, vectors, projection(width, seed), k, limit)),
                            columns=["query_id", "vec_id", "score"],
                        ).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        return index.mapInPandas(run, NEIGHBOURS)

    parts = -(-asked.count() // batch)
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, parts)))
    found = [answers(asked.where(number == i).toPandas()) for i in range(parts)]
    both = reduce(DataFrame.union, found) if found else spark.createDataFrame([], NEIGHBOURS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
