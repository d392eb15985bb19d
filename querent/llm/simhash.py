"""SimHash near duplicates by a self-join of the binary trie of fingerprints.

The trie is cut at a depth that keeps subtrees small.  A task gets a pair of
subtrees whose paths differ within the error budget and walks their nodes in
pairs, level by level: differing bits add up, and a pair beyond the budget goes
with all that lies below it.  Equal texts and equal fingerprints meet before
the trie is built, and a task reports a spanning forest of its links, never the
links themselves, so a dense family costs no more rows than it has members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import materialize
from .common import fresh
from .components import components

BUDGET = 2
SHINGLE = 3
SEED = 42
_CHUNK = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    run = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(run[a:b], seed) for a, b in cuts), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


class Forest:
    """Union-find over node numbers, many links at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.roots(x), self.roots(y)
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def trie_links(values: np.ndarray, left: slice, right: slice, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Root of each of ``values`` under links between two sorted subtrees.

    ``left`` and ``right`` are the subtrees of ``values`` (unsigned), either the
    same one or disjoint; ``depth`` is the number of leading bits each has in
    common.
    """
    forest = Forest(len(values))
    one = np.uint64(1)
    spread = int((values[left.start] ^ values[right.start]) >> np.uint64(64 - depth)).bit_count() if depth else 0
    stack = [(depth, *(np.array([v]) for v in (left.start, left.stop, right.start, right.stop, spread)))]
    while stack:
        level, al, ah, bl, bh, apart = stack.pop()
        small = (ah - al) * (bh - bl) <= 8
        if level == 64:
            small[:] = True  # every pair below is equal in all bits counted so far
        if small.any():
            rows, cols = (ah - al)[small], (bh - bl)[small]
            each = rows * cols
            at = np.repeat(np.arange(len(each)), each)
            nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            x = al[small][at] + nth // cols[at]
            y = bl[small][at] + nth % cols[at]
            near = np.bitwise_count(values[x] ^ values[y]) <= budget
            forest.unite(x[near], y[near])
        keep = ~small
        al, ah, bl, bh, apart = (v[keep] for v in (al, ah, bl, bh, apart))
        if not len(al):
            continue
        if len(al) > _CHUNK:
            half = len(al) // 2
            stack += [(level, *(v[s] for v in (al, ah, bl, bh, apart))) for s in (slice(half), slice(half, None))]
            continue
        bit = np.uint64(63 - level)
        mask = ~((one << bit << one) - one) if level else np.uint64(0)
        am, bm = (
            np.clip(np.searchsorted(values, (values[lo] & mask) | (one << bit)), lo, hi)
            for lo, hi in ((al, ah), (bl, bh))
        )
        same = (al == bl) & (ah == bh)
        parts = [
            (al, am, bl, bm, apart, np.ones(len(al), bool)),
            (am, ah, bm, bh, apart, np.ones(len(al), bool)),
            (al, am, bm, bh, apart + 1, apart < budget),
            (am, ah, bl, bm, apart + 1, (apart < budget) & ~same),
        ]
        nxt = [
            tuple(v[ok & (p[1] > p[0]) & (p[3] > p[2])] for v in p[:5]) for *p, ok in parts
        ]
        stack.append((level + 1, *(np.concatenate(v) for v in zip(*nxt, strict=True))))
    return forest.roots(np.arange(len(values)))


def _subtree_pair(depth: int, budget: int):
    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(rows["print"].to_numpy().view(np.uint64))
        # the two subtrees are the runs of equal leading bits
        cut = len(values)
        if key[0] != key[1]:
            cut = int(np.searchsorted(values, np.uint64(int(key[1]) << (64 - depth))))
        left = slice(0, cut)
        right = left if key[0] == key[1] else slice(cut, len(values))
        if right.stop == right.start or left.stop == left.start:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        roots = trie_links(values, left, right, depth, budget)
        linked = np.flatnonzero(roots != np.arange(len(values)))
        return pd.DataFrame({"a": values[linked].view(np.int64), "b": values[roots[linked]].view(np.int64)})

    return join


def near_links(prints: DataFrame, budget: int = BUDGET, subtree: int = 1 << 13) -> DataFrame:
    """Links ``a, b`` that connect what ``budget`` or fewer differing bits connect.

    ``prints`` holds distinct fingerprints.  Depth grows with their number, so a
    subtree has about ``subtree`` of them, and each of them goes to one task
    for each path of that depth within the budget.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, prints.count()) / subtree))))
    masks = [
        sum(1 << b for b in bits) for n in range(min(budget, depth) + 1) for bits in combinations(range(depth), n)
    ]
    own = F.shiftrightunsigned("print", 64 - depth) if depth else F.lit(0).cast("long")
    other = F.col("own").bitwiseXOR(F.col("mask"))
    pairs = (
        prints.select("print", own.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
        .select("print", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"))
    )
    return pairs.groupBy("low", "high").applyInPandas(_subtree_pair(depth, budget), "a long, b long")


def clusters(prints: DataFrame) -> DataFrame:
    """``print, root, component_id``: the smallest doc_id of the component, null where all are null.

    ``root`` is a fingerprint of the component and its own: a doc_id that occurs
    with several texts may be the smallest of several components.

    ``prints`` has doc_id and print, one row per document.
    """
    firsts = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(near_links(firsts.select("print")))
    placed = firsts.join(roots, firsts["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(least, "root").select("print", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, print, component_id`` of every row of ``docs``.

    Documents link when their fingerprints differ in two bits or fewer.  A null
    text is one without words; all of those have fingerprint 0 and link like
    any others.  Repeated rows stay; other columns are not looked at.
    """
    prints = materialize(docs.select("doc_id", fingerprints("text").alias("print")), "fingerprints")
    return prints.join(clusters(prints), "print").select("doc_id", "print", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of smallest doc_id, nulls last.

    Of rows that share that doc_id the one of smallest text hash stays, of
    equal rows any one.  All columns are kept.
    """
    code = fresh(docs, "_text")
    marks = materialize(
        docs.select("doc_id", F.xxhash64("text").alias("code"), fingerprints("text").alias("print")), "fingerprints"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code"))
    kept = (
        marks.join(clusters(marks.select("doc_id", "print")), "print")
        .groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.code").alias("_code"))
    )
    coded = docs.withColumn(code, F.xxhash64("text"))
    return (
        coded.join(kept, coded["doc_id"].eqNullSafe(kept["_id"]) & (coded[code] == kept["_code"]), "left_semi")
        .dropDuplicates(["doc_id", code]).drop(code)
    )
