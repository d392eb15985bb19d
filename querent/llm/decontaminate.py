"""Benchmark decontamination by winnowing.

Of every ``SPAN - GRAM + 1`` consecutive k-gram hashes the smallest (the last of
equal ones) is a fingerprint, for benchmark items and documents alike.  Whatever
``SPAN`` words the two share, they choose the same fingerprint inside it, so
joining fingerprints finds every shared span; each hit is then extended to the
windows around it and confirmed word by word.

The benchmark meets the documents in portions of bounded size, one after the
other within the same scan, so documents are never shuffled and a benchmark of
any size is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 10
GRAM = 5
#: Words in lower case: what is no ASCII letter or digit separates, all else stays.
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the last of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    for j in range(1, window):
        best = np.where(hashes[j : j + n] <= hashes[best], np.arange(j, j + n), best)
    return np.unique(best)


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


@dataclass
class Portion:
    """Fingerprints and windows of some benchmark items, by window length."""

    span: int = SPAN
    gram: int = GRAM
    prints: dict[int, np.ndarray] = field(default_factory=dict)
    windows: dict[bytes, tuple[str | None, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: pd.DataFrame, span: int, gram: int) -> Portion:
        found: dict[int, list[np.ndarray]] = {}
        windows: dict[bytes, set[str | None]] = {}
        for item, text in items[["item_id", "text"]].itertuples(index=False):
            words = words_of(text if isinstance(text, str) else None)
            item = item if isinstance(item, str) else None
            if not words:
                continue
            length = min(span, len(words))
            for s in range(len(words) - length + 1):
                windows.setdefault(b" ".join(words[s : s + length]), set()).add(item)
            k = gram if length == span else length
            hashes = gram_hashes(_codes(words), k)
            found.setdefault(length, []).append(hashes[winnow(hashes, length - k + 1)])
        return cls(
            span, gram, {n: np.unique(np.concatenate(h)) for n, h in found.items()},
            {w: tuple(i) for w, i in windows.items()},
        )

    def hits(self, words: list[bytes], codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans (start, end) of the windows that occur, and their items."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for length, prints in self.prints.items():
            k = self.gram if length == self.span else length
            hashes = gram_hashes(codes, k)
            at = winnow(hashes, length - k + 1)
            at = at[np.isin(hashes[at], prints)]
            if not len(at):
                continue
            # extend: every window that holds the fingerprint
            starts = np.unique((at[:, None] - np.arange(length - k + 1)).ravel())
            for s in starts[(starts >= 0) & (starts + length <= len(words))].tolist():
                if of := self.windows.get(b" ".join(words[s : s + length])):
                    spans.append((s, s + length))
                    items.update(of)
        return spans, items


def _portions(benchmark: DataFrame, chars: int) -> list[pd.DataFrame]:
    """The benchmark in portions of about ``chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    return [
        items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toPandas().astype(object) for i in range(n)
    ]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, out: str, span: int = SPAN, gram: int = GRAM,
    portion_chars: int = 16_000_000,
) -> DataFrame:
    """``docs`` with ``out``: a struct of ``n_words``, ``n_hit``, ``items`` and ``spans``.

    A window is ``span`` consecutive words of an item; an item of fewer words is
    one window.  ``spans`` are word ranges (end exclusive) of the document that
    are hit, merged and ascending, ``items`` the items they stem from, sorted as
    strings, a null id last.  A null text has no words; items without words match
    nothing; items that share an id, the null id too, count once.
    """
    sc = docs.sparkSession.sparkContext
    kind = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    portions = [sc.broadcast(Portion.of(p, span, gram)) for p in _portions(benchmark, portion_chars)]

    @F.pandas_udf(kind)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                codes = _codes(words)
                spans: list[tuple[int, int]] = []
                items: set[str | None] = set()
                for portion in portions:
                    some, of = portion.value.hits(words, codes)
                    spans += some
                    items |= of
                merged: list[dict[str, int]] = []
                for s, e in sorted(spans):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(e, merged[-1]["end"])
                    else:
                        merged.append({"start": s, "end": e})
                rows.append((len(words), sum(m["end"] - m["start"] for m in merged), [*sorted(i for i in items if i is not None), *[None] * (None in items)], merged))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return docs.withColumn(out, match("text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the spans of every document."""
    return decontaminate(docs.select("doc_id", "text"), benchmark, "found").select(
        "doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
        "found.spans",
    )
