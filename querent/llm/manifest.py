"""Merkle manifest of a table, with proofs from stored checkpoints.

Every row is a leaf; the leaves of one tree, in order, are hashed by runs of
eight until one node remains, and the roots of the trees are leaves of one more
tree.  Only every third level is written.  A proof needs all the levels: each
aligned subtree between two written levels is rebuilt from its stored nodes (512
at most), inside one row, gives the siblings of its nodes, and is dropped again.

Texts are read once, for the leaves.  What moves afterwards are digests, keyed by
(tree, subtree), so that a tree that holds most of the rows is spread like the
others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, once
from ..operators.ranking import with_ordinal
from ..session import materialize

FANOUT = 8
#: Levels from one written level to the next.
EVERY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def joined_hash(digests: Column) -> Column:
    return F.sha2(F.concat_ws("", digests), 256)


def leaf_hash(**fields: Column) -> Column:
    """Hash of the fields in their order: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    shown = [v.cast("string") for v in fields.values()]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256
    )


def lower_case(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


@dataclass(frozen=True)
class Forest:
    """Trees over ordered leaves.

    ``bands[i]`` holds the nodes of level ``i * every``: ``tree, pos, digest,
    height`` (levels from leaf to root of the tree), band 0 also ``payload``.
    ``roots``: ``tree, digest``.
    """

    bands: list[DataFrame]
    roots: DataFrame
    every: int


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node remains."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda i: F.pow(F.lit(float(FANOUT)), i) < n))


def _subtrees(nodes: DataFrame, band: int, every: int) -> DataFrame:
    """One row per aligned subtree: ``tree, part, height, nodes`` and its levels ``l0`` to ``l<every>``.

    A level that the tree does not have repeats the one below.
    """
    width = FANOUT**every
    keep = [c for c in ("payload",) if c in nodes.columns]
    rows = (
        nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("part"))
        .agg(F.first("height").alias("height"), F.array_sort(F.collect_list(F.struct("pos", "digest", *keep))).alias("nodes"))
    )
    rows = once(rows, l0=F.transform("nodes", lambda x: x["digest"]))
    for i in range(every):
        below = F.col(f"l{i}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FANOUT).cast("int"))
        above = F.transform(runs, lambda r: joined_hash(F.slice(below, r * FANOUT + 1, FANOUT)))  # noqa: B023
        rows = once(rows, **{f"l{i + 1}": F.when(F.lit(band * every + i) < F.col("height"), above).otherwise(below)})
    return rows


def grow(leaves: DataFrame, every: int = EVERY) -> Forest:
    """Trees over ``leaves`` (tree, pos from 0 without gaps, digest, payload).

    ``tree`` is no null.  No leaves make no trees.
    """
    sizes = materialize(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    tallest = sizes.agg(F.max(_height(F.col("n")))).first()[0] or 0
    heights = sizes.select("tree", _height(F.col("n")).alias("height"))
    bands = [materialize(leaves.join(heights, "tree"), "leaves")]
    for band in range(-(-tallest // every)):
        top = _subtrees(bands[-1].drop("payload"), band, every)
        bands.append(materialize(top.select("tree", F.col("part").alias("pos"), F.get(f"l{every}", F.lit(0)).alias("digest"), "height"), "level"))
    return Forest(bands, bands[-1].select("tree", "digest"), every)


def _siblings(i: Column, band: int, every: int) -> Column:
    """Path of node ``i`` of a subtree: its siblings to the left and right, level by level."""

    def entry(k: int) -> Column:
        level = F.col(f"l{k}")
        at = F.floor(i / FANOUT**k).cast("int")
        return bind(
            F.slice(level, at - at % FANOUT + 1, FANOUT),
            lambda run: F.struct(
                F.concat_ws("", F.slice(run, F.lit(1), at % FANOUT)).alias("left"),
                F.concat_ws("", F.slice(run, at % FANOUT + 2, F.lit(FANOUT))).alias("right"),
            ),
        )

    return F.array_compact(F.array(*[
        F.when(F.lit(band * every + k) < F.col("height"), entry(k)) for k in range(every)
    ])).cast(_PATH)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """``payload, digest, path`` of every leaf, and the columns of ``above``.

    ``above`` has a row per tree: ``tree, path`` (from its root on) and more
    columns, which are passed on.  Subtrees are rebuilt from the top down; a
    path holds seven digests a level at most, and is made where it is used.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    parents = above.withColumn("part", F.lit(0).cast("long")).withColumnRenamed("path", "rest")
    every = forest.every
    if len(forest.bands) == 1:  # leaves that are roots
        return forest.bands[0].join(above, "tree").select("payload", "digest", "path", *more)
    for band in reversed(range(len(forest.bands) - 1)):
        rows = _subtrees(forest.bands[band], band, every).join(parents, ["tree", "part"])
        named = lambda x, i: F.struct(
            *([x["payload"].alias("payload"), x["digest"].alias("digest")] if band == 0 else [x["pos"].alias("part")]),  # noqa: B023
            F.concat(_siblings(i, band, every), F.col("rest")).alias("path"),  # noqa: B023
        )
        own = rows.select("tree", *more, F.inline(F.transform("nodes", named)))
        # leaves' paths are used at once; those of inner nodes are few
        parents = own if band == 0 else materialize(own.withColumnRenamed("path", "rest"), "paths")
    return parents.drop("tree")


def proof_hash(path: Column) -> Column:
    """Hash of all the siblings of a path, in its order."""
    return joined_hash(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


@dataclass(frozen=True)
class Manifest:
    """The trees of a table, one per language, and the tree over their roots."""

    trees: Forest
    top: Forest

    def proofs(self) -> DataFrame:
        """``payload, digest, path, subroot, root`` of every leaf."""
        root = self.top.roots.select("tree", F.lit(None).cast(_PATH).alias("path"), F.col("digest").alias("root"))
        root = root.withColumn("path", F.array().cast(_PATH))
        subroots = paths(self.top, root).select(
            F.col("payload.tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
        )
        return paths(self.trees, materialize(subroots, "subroots"))


def build_manifest(leaves: DataFrame, every: int = EVERY) -> Manifest:
    """Manifest over ``leaves``: ``lang, doc_id, leaf, payload``.

    Leaves of a language ascend by doc_id, a null first; rows of one doc_id by
    their digests, so that only rows equal in all fields are interchangeable.
    Languages ascend by their bytes, a null first.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    placed = with_ordinal(leaves.select(tree.alias("tree"), "doc_id", "leaf", "payload"), ["tree"], "doc_id", "leaf", "pos")
    trees = grow(placed.select("tree", F.col("pos") - 1, F.col("leaf").alias("digest"), "payload").toDF("tree", "pos", "digest", "payload"), every)
    one = trees.roots.select(F.lit("").alias("all"), "tree", "digest")
    ordered = with_ordinal(one, ["all"], "tree", None, "pos")
    top = grow(
        ordered.select(F.col("all").alias("tree"), (F.col("pos") - 1).alias("pos"), "digest", F.struct("tree").alias("payload")), every
    )
    return Manifest(trees, top)


def verify_documents(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Where 3 divides the CRC-32 of the id, the leaf is recomputed from a text
    whose A-Z are lower-cased; its proof then fails, unless the text has none of
    these.  A null id has no CRC-32, and null texts stay; empty and very long
    texts are hashed like others.  Repeated rows are leaves of their own.  An
    empty table gives no rows.  Further columns of ``docs`` are not read.
    """
    fields = {c: F.col(c) for c in FIELDS}
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = materialize(
        docs.select(
            "lang", "doc_id", leaf_hash(**fields).alias("leaf"),
            F.struct(
                F.col("doc_id").alias("id"),
                F.when(altered, leaf_hash(**fields | {"text": lower_case(F.col("text"))})).alias("altered"),
            ).alias("payload"),
        ),
        "leaf-hashes",
    )
    found = build_manifest(leaves, every).proofs()
    return found.select(
        F.col("payload.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root",
        proof_hash(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("payload.altered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
