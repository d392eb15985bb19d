"""Mixing sources to target weights, in blocks of fixed length.

The words of a source's documents form one stream, cut into blocks.  Every
output shard draws how many of its slots each source fills; a source's slots
are numbered through all shards and mapped, pass by pass, through pseudorandom
permutations of its block numbers; slots and blocks then meet on that number.
No slot looks at another one, so nothing is shuffled but the join itself, and
its key (source, block) is never hot, whatever a source's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialize
from .common import blocks_for, fresh, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 16_384
SEED = 0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_id, source_size, target`` from ``source, source_size`` (a row per source).

    Sources by code point, null last, take the weights in turn and share the
    sum of all sizes; none gets more than ``most`` times its size, and what it
    leaves goes to the others by weight: the water level solves it in one pass.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most
    ranked = (
        sizes.withColumn("source_id", F.row_number().over(names) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")))
        .withColumn("full_at", cap / F.col("weight"))
    )
    filling = Window.orderBy("full_at", "source_id")
    before, on = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    own = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / F.sum("weight").over(on)
    level = F.min(
        F.when(F.col("own") <= F.col("full_at"), F.struct("full_at", "source_id", "own"))
    ).over(everything)["own"]
    return ranked.withColumn("own", own).withColumn("level", level).select(
        "source", "source_id", "source_size",
        F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), cap.cast("double"))).alias("target"),
    )


def permute(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each ``at`` in a pseudorandom permutation of ``range(n)`` chosen by ``key``.

    A four-round Feistel network over the next power of four, walked until the
    place is in range.
    """
    half = np.array([max(1, -(-(int(v) - 1).bit_length() // 2)) for v in n], np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            f = (right + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) ^ k
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@F.pandas_udf(LongType())
def _block_of(place: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(place.to_numpy(), blocks.to_numpy(), key.to_numpy().view(np.uint64)))


@dataclass
class Mix:
    """``sized``: documents with source_id, size and first word; ``slots``: shard, slot, source_id, block."""

    sized: DataFrame
    slots: DataFrame
    targets: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """Parts of documents in blocks: ``source_id, start, block, skip, words``."""
        first, end, b = F.col("start"), F.col("start") + F.col("size"), self.block_words
        cut = self.sized.where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(first / b), F.floor((end - 1) / b)))
        )
        low, high = F.greatest(first, F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
        return cut.withColumn("skip", low - first).withColumn("words", high - low)

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words that the mix takes of them, repeats counted."""
        times = self.slots.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
        own = self.sized.columns
        some = (
            self.pieces().join(times, ["source_id", "block"], "left")
            .groupBy(*own).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
        )
        return some.union(self.sized.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken")))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS, seed: int = SEED, block_rows: int = 16_384,
) -> Mix:
    """Plan a mix of all of ``docs``.

    A shard gets the whole part of each source's share and draws the rest of
    its slots from the multinomial of what is left, so shares hold in every
    shard and sums stay near the targets.  A block is used once per pass and in
    ``most`` passes at most.  A null source is a source; a null text has no
    words, and documents without words take part in nothing.  Rows that share a
    doc_id are documents of their own.  All choices hang on ``seed``.
    """
    spark = docs.sparkSession
    narrow = materialize(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("code")), "sizes"
    )
    targets = materialize(
        source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets"
    )
    by_source = F.col("t.source").eqNullSafe(F.col("n.source"))
    sized = materialize(
        prefix_sums(
            narrow.alias("n").join(targets.alias("t"), by_source).select(
                "n.doc_id", "code", "t.source_id", "t.source_size", "t.target", "size"
            ),
            "source_id", ["doc_id", "code"], F.col("size"), "start", blocks_for(narrow, block_rows),
        ),
        "stream",
    )
    # one row for each mixing weight: this is configuration, not data
    rows = targets.where("source_size > 0").orderBy("source_id").select("source_id", "source_size", "target").collect()
    ids = np.array([r["source_id"] for r in rows], np.int64)
    blocks = np.array([-(-r["source_size"] // block_words) for r in rows], np.int64)
    share = blocks * np.array([r["target"] / r["source_size"] for r in rows])
    shards = max(1, int(np.ceil(share.sum() / shard_slots)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = share / shards
        whole = np.floor(mine + 1e-9)
        rest = np.maximum(mine - whole, 0)
        left = int(round(rest.sum()))
        for batch in batches:
            for shard in batch["shard"]:
                chance = np.random.default_rng([seed, int(shard)])
                n = (whole + (chance.multinomial(left, rest / rest.sum()) if left else 0)).astype(np.int64)
                yield pd.DataFrame({"shard": int(shard), "source_id": ids, "blocks": blocks, "n": n})

    counts = (
        spark.range(shards if len(rows) else 0).select(F.col("id").alias("shard"))
        .mapInPandas(draw, "shard long, source_id int, blocks long, n long")
    )
    through = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("number")
    slots = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(through), F.lit(0)))
        .withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .where("n > 0").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("number", F.col("before") + F.col("nth"))
        .where(number < F.col("blocks") * most)
        .select(
            "shard", (F.col("first") + F.col("nth")).alias("slot"), "source_id",
            _block_of(
                number % F.col("blocks"), F.col("blocks"),
                F.xxhash64(F.lit(seed), "source_id", F.floor(number / F.col("blocks"))),
            ).alias("block"),
        )
    )
    # written, so that Spark knows its size when it chooses how to join it
    return Mix(sized, materialize(slots, "slots"), targets, block_words)


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``shard, slot, source_id, text``, a block of words for each slot."""
    plan = mix(docs, **options)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_code"), words.alias("all")).distinct()
    parts = plan.pieces().join(
        texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("code") == F.col("_code"))
    ).select(
        "source_id", "block",
        F.struct("start", F.slice("all", (F.col("skip") + 1).cast("int"), F.col("words").cast("int")).alias("w")).alias("part"),
    )
    # a block has at most block_words parts
    blocks = parts.groupBy("source_id", "block").agg(
        F.concat_ws(" ", F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["w"]))).alias("text")
    )
    return plan.slots.join(blocks, ["source_id", "block"]).select("shard", "slot", "source_id", "text")


def resample(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every document as often as the mix takes it, all columns kept.

    The words taken over the document's size is rounded up or down by a hash of
    the row, so the expected number of copies is exact and texts stay whole.
    """
    code, copy = fresh(docs, "_text"), fresh(docs, "_copy")
    ratio = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "code"), F.lit(1 << 20)) / float(1 << 20)
    copies = (
        mix(docs, **options).taken().groupBy("doc_id", "code", "size").agg(F.avg("taken").alias("taken"))
        .select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), F.floor(ratio + chance).cast("int").alias("_n"))
        .where("_n > 0")
    )
    coded = docs.withColumn(code, F.xxhash64("text"))
    return (
        coded.join(copies, coded["doc_id"].eqNullSafe(copies["_id"]) & (coded[code] == copies["_code"]))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), copies["_n"])))
        .select(*[coded[c] for c in docs.columns])
    )
