"""Sharding: a hierarchical weighted hash tree.

A key descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's path, and the
smallest draw wins, so a child gets its share of the weight.  A child's draw
depends on nothing but itself: when weights change, keys move only to or from
the subtrees whose weights changed.

Native expressions throughout; placing needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, prefix_sums


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


Tree = tuple[Shard, ...]


def plan_tree(shards: int = 16, racks: int = 2, per_rack: int = 2) -> Tree:
    """``shards`` shards of equal weight in regions of ``racks * per_rack``."""
    per_region = racks * per_rack
    return tuple(
        Shard(f"region{i // per_region}", f"rack{i % per_region // per_rack}", i)
        for i in range(shards)
    )


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region of its own.

    Since no other subtree changes its weight, keys move only into the new
    shard.
    """
    number = max(s.number for s in tree) + 1
    return (*tree, Shard(f"grown{number}", "rack0", number, weight))


def _draw(key: Column, path: str, weight: float, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}/{path}"), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def place(key: Column, tree: Tree, seed: int = 0) -> Column:
    """Number of the shard that ``key`` descends to.

    A null key is a key like any other.  Equal keys go to equal shards; shards
    of weight zero get nothing.
    """

    def descend(shards: Tree, levels: tuple[str, ...], path: str) -> Column:
        if not levels:
            return F.lit(shards[0].number)
        children: dict[object, list[Shard]] = {}
        for s in shards:
            if s.weight > 0:
                children.setdefault(getattr(s, levels[0]), []).append(s)
        branches = [
            (f"{path}/{name}", tuple(below)) for name, below in children.items()
        ]
        if len(branches) == 1:
            return descend(branches[0][1], levels[1:], branches[0][0])
        best = F.array_min(F.array(*[
            F.struct(_draw(key, p, sum(s.weight for s in below), seed).alias("draw"), F.lit(i).alias("child"))
            for i, (p, below) in enumerate(branches)
        ]))["child"]
        # the last level needs no second look at its winner
        if len(levels) == 1:
            return F.element_at(F.array(*[F.lit(b[0].number) for _, b in branches]), best + 1)
        return F.element_at(
            F.transform(
                F.array(best),
                lambda c: _choose(c, [descend(b, levels[1:], p) for p, b in branches]),
            ),
            1,
        )

    return descend(tree, ("region", "rack", "number"), "")


def _choose(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(index == i, option)
    return out


def shard_documents(
    docs: DataFrame, tree: Tree | None = None, seed: int = 0, block_rows: int = 16_384
) -> DataFrame:
    """``doc_id, text_crc32, size, shard, slot, grown_shard`` of every document.

    ``size`` is the UTF-8 length of the text plus one, 1 for a null text, whose
    checksum is that of no bytes.  ``slot`` counts gaplessly from 0 in each
    shard.  Rows that repeat a doc_id, null included, share its shard and get
    slots of their own.  Other columns are not looked at.
    """
    tree = tree or plan_tree()
    key = F.col("doc_id")
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        place(key, tree, seed).alias("shard"),
        place(key, grow(tree), seed).alias("grown_shard"),
    )
    return prefix_sums(
        placed, "shard", ["doc_id", "text_crc32"], F.lit(1).cast("long"), "slot",
        blocks_for(docs, block_rows),
    )


def shard_rows(docs: DataFrame, tree: Tree | None = None, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` with ``shard`` added (any such column replaced)."""
    kept = docs.drop("shard") if "shard" in docs.columns else docs
    return kept.withColumn("shard", place(F.col("doc_id"), tree or plan_tree(), seed))
