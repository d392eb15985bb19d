"""Greedy batches of ordered rows, for groups of any size.

A batch closes when the next item would exceed the character limit or the batch
holds the maximal number of items.  A group is cut into blocks of consecutive
rows; since no batch holds more than ``max_items`` rows, a block can be entered
at ``max_items`` positions only, so a short table of (entry -> exit, batches)
describes it completely.  The tables of a group are chained, then every block
numbers its own rows.  All groups go this way, whatever their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import last
from ..session import materialize
from .ranking import with_ordinal

BLOCK_ROWS = 50_000


def _next_start(lens: np.ndarray, max_chars: int, max_items: int) -> np.ndarray:
    """For every position the first position that a batch begun there excludes."""
    n = len(lens)
    total = np.concatenate([[0], np.cumsum(lens + 2)])
    idx = np.arange(n)
    # Behind a flush the first item counts without its separator.
    fresh = np.searchsorted(total, total[:-1] + max_chars + 2, side="right") - 1
    return np.minimum(np.maximum(fresh, idx + 1), np.minimum(idx + max_items, n))


def _exits(nxt: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position where the chain of batches leaves ``n`` rows, and after how many."""
    size = max(int(nxt.max(initial=0)), n) + 1
    goal = np.arange(size)
    goal[:n] = nxt[:n]
    steps = (np.arange(size) < n).astype(np.int64)
    while (goal[:n] < n).any():  # each round doubles the steps taken
        steps = steps + steps[goal]
        goal = goal[goal]
    return goal, steps


def pack_batches(
    df: DataFrame, keys: list[str], order: str, text: str, max_chars: int = 2500, max_items: int = 50,
    block_rows: int = BLOCK_ROWS, parts: int | None = None,
) -> DataFrame:
    """(keys, order, batch): batch numbers from 1 inside every group."""
    slim = df.select(*keys, F.col(order).alias("_o"), F.length(text).cast("bigint").alias("_len"))
    ranked = materialize(with_ordinal(slim, keys, "_o", name="_i", parts=parts), "ranked")
    pos = F.col("_i") - 1
    own = ranked.withColumn("_b", F.floor(pos / block_rows)).withColumn("_halo", F.lit(False))
    halo = own.where((pos % block_rows < max_items) & (F.col("_b") > 0)).withColumn(
        "_b", F.col("_b") - 1
    ).withColumn("_halo", F.lit(True))
    # a call of Python gets about one block of rows: many small groups or one block of a large one
    calls = max(1, -(-ranked.count() // block_rows))
    blocks = own.unionByName(halo).withColumn("_call", F.pmod(F.xxhash64(*keys, "_b"), F.lit(calls)))
    key_ddl = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)

    def groups(pdf: pd.DataFrame):
        """Rows by group, block and order, and where each block begins and ends."""
        codes = pdf.groupby([*keys, "_b"], sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((pdf["_i"].to_numpy(), codes))
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        return pdf.iloc[order], starts, np.append(starts[1:], len(pdf))

    # The first batch of a group is the only one whose first item carries the
    # separator, so its end differs; entry `max_items` stands for that start.
    def moves(lens: np.ndarray):
        nxt = _next_start(lens, max_chars, max_items)
        first = int(np.searchsorted(np.cumsum(lens[: max_items + 1] + 2), max_chars, side="right"))
        return nxt, max(1, min(first, max_items, len(lens)))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts, ends = groups(pdf)
        lens, inside_block = pdf["_len"].to_numpy(np.int64), ~pdf["_halo"].to_numpy(bool)
        entry = np.arange(max_items)
        exits, mades = [], []
        for s, e in zip(starts, ends, strict=True):
            n = int(inside_block[s:e].sum())
            nxt, first = moves(lens[s:e])
            goal, steps = _exits(nxt, n)
            inside = np.minimum(entry, n)
            leave = np.where(entry < n, goal[inside], entry) - n
            made = np.where(entry < n, steps[inside], 0)
            after = (first - n, 1) if first >= n else (goal[first] - n, steps[first] + 1)
            exits.append([*leave.tolist(), int(after[0])])
            mades.append([*made.tolist(), int(after[1])])
        out = pdf[[*keys, "_b"]].iloc[starts].reset_index(drop=True)
        return out.assign(_exit=exits, _made=mades)

    tables = blocks.groupBy("_call").applyInPandas(
        table, f"{key_ddl}, _b bigint, _exit array<bigint>, _made array<bigint>"
    )

    def chain(acc, x):
        here = last(acc["at"])
        e = here["e"].cast("int")
        then = F.struct(
            F.get(x["_exit"], e).alias("e"), (here["m"] + F.get(x["_made"], e)).alias("m")
        )
        return F.struct(F.concat(acc["at"], F.array(then)).alias("at"))

    start = F.struct(
        F.array(F.struct(F.lit(max_items).cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("m"))).alias("at")
    )
    entries = (
        tables.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_b", "_exit", "_made"))).alias("_t"))
        .select(*keys, F.posexplode(F.aggregate("_t", start, chain, lambda a: F.slice(a["at"], 1, F.size(a["at"]) - 1))).alias("_b", "_s"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").cast("bigint").alias("_eb"),
            F.col("_s.e").alias("_entry"), F.col("_s.m").alias("_before"),
        )
    )
    same = F.col("_b") == F.col("_eb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts, ends = groups(pdf)
        lens, inside_block = pdf["_len"].to_numpy(np.int64), ~pdf["_halo"].to_numpy(bool)
        entry, before = pdf["_entry"].to_numpy(np.int64), pdf["_before"].to_numpy(np.int64)
        batch = np.zeros(len(pdf), np.int64)
        for s, e in zip(starts, ends, strict=True):
            n = int(inside_block[s:e].sum())
            nxt, first = moves(lens[s:e])
            i, jump = (0, first) if entry[s] == max_items else (int(entry[s]), None)
            while i < n:  # one step per batch
                batch[s + i] = 1
                i, jump = (jump, None) if jump is not None else (int(nxt[i]), None)
            batch[s:e] = before[s] + np.cumsum(batch[s:e])
        return pdf[[*keys, "_o"]].assign(batch=batch)[inside_block]

    o_type = slim.schema["_o"].dataType.simpleString()
    return (
        blocks.join(entries, same).drop(*entries.columns[: len(keys) + 1])
        .groupBy("_call").applyInPandas(number, f"{key_ddl}, _o {o_type}, batch bigint")
        .select(*keys, F.col("_o").alias(order), "batch")
    )
