"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled documents is the example set.  Its vocabulary is
the words and word beginnings that stand almost only in toxic documents, beyond
chance (a likelihood-ratio test on distinct documents, near copies counted
once); their document frequencies come from all documents.  The examples lie in a block-max inverted index that every task
holds; a document visits blocks by falling upper bound and stops when no block
left can reach its k-th neighbour, so neighbours are exact.  Neighbours vote
with their cosine, each class weighted back from its sample to its size among
all labelled documents; the votes give the score and are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WORD = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that are terms of their own.
STEMS = (4, 5)
THRESHOLD = 0.7
BLOCK = 64


def learnable(doc_id: Column) -> Column:
    """False for the held-out third of the ids; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def features(text: str | None) -> Counter:
    """Counts of words, and of word beginnings (marked ``*``)."""
    found = Counter(WORD.findall((text or "").lower()))
    for w, n in list(found.items()):
        for k in STEMS:
            if len(w) > k:
                found[f"{w[:k]}*"] += n
    return found


@dataclass
class Vocabulary:
    """Places of terms, found in a text without building its other features."""

    terms: list[str]

    def __post_init__(self) -> None:
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.stems = {t[:-1]: i for t, i in self.place.items() if t.endswith("*")}

    def count(self, text: str | None) -> Counter:
        found: Counter = Counter()
        place, stems = self.place, self.stems
        for w, n in Counter(WORD.findall((text or "").lower())).items():
            if w in place:
                found[place[w]] += n
            for k in STEMS:
                if w[:k] in stems and len(w) > k:
                    found[stems[w[:k]]] += n
        return found


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms with counts, and four min-hashes of three-word shingles."""
    from zlib import crc32

    mixers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    # a few rows at a time: a row's terms take many times the room of its text
    for batch in (b.iloc[at : at + 128] for b in batches for at in range(0, len(b), 128)):
        words, counts, mins = [], [], []
        for text in batch["text"]:
            found = WORD.findall((text or "").lower())
            tally = features(text)
            words.append(list(tally))
            counts.append(list(tally.values()))
            codes = np.fromiter((crc32(w.encode()) for w in found), np.uint64, len(found))
            runs = codes if len(codes) < 3 else codes[:-2] * np.uint64(31) ** np.uint64(2) + codes[1:-1] * np.uint64(31) + codes[2:]
            if not len(runs):
                mins.append([])
                continue
            low = []
            for m in mixers:
                mixed = (runs ^ (runs >> np.uint64(17)) ^ m) * m
                low.append(int(((mixed ^ (mixed >> np.uint64(31))) * m).min().view(np.int64)))
            mins.append(low)
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": words, "counts": counts, "mins": mins,
        })


def _distinct(features: pd.DataFrame) -> set[int]:
    """Ids of the sample without near copies of smaller ids."""
    seen: set[tuple[int, int]] = set()
    kept = set()
    for doc_id, mins in features.sort_values("doc_id").itertuples(index=False):
        keys = set(enumerate(mins))
        if keys and keys & seen:
            continue
        seen |= keys
        kept.add(int(doc_id))
    return kept


@dataclass
class Index:
    """Block-max inverted index over unit vectors of the examples."""

    terms: Vocabulary
    idf: np.ndarray
    blocks: list[np.ndarray]  # per term: blocks with postings
    most: list[np.ndarray]  # per term: largest weight in each of them
    starts: list[np.ndarray]  # per term: where each block's postings begin, and the end
    docs: list[np.ndarray]  # per term: examples, ascending
    weights: list[np.ndarray]
    toxic: np.ndarray  # per example: label
    value: np.ndarray  # per example: weight of its class
    ids: np.ndarray
    prior: float
    silent: float  # rate among documents without any term

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest positive cosine, ties to smaller ids."""
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for t, q in query.items():
            bound[self.blocks[t]] += q * self.most[t]
        order = np.argsort(-bound, kind="stable")
        found, scores = np.empty(0, np.int64), np.empty(0)
        for b in order:
            if bound[b] <= 0 or (len(scores) == k and bound[b] < scores[-1] - 1e-9):
                break
            dots = np.zeros(BLOCK)
            for t, q in query.items():
                at = np.searchsorted(self.blocks[t], b)
                if at < len(self.blocks[t]) and self.blocks[t][at] == b:
                    s, e = self.starts[t][at], self.starts[t][at + 1]
                    dots[self.docs[t][s:e] - b * BLOCK] += q * self.weights[t][s:e]
            hit = np.flatnonzero(dots > 0)
            found, scores = np.concatenate([found, hit + b * BLOCK]), np.concatenate([scores, dots[hit]])
            top = np.lexsort((self.ids[found], -scores))[:k]
            found, scores = found[top], scores[top]
        return found, scores

    def vector(self, counts: Counter) -> dict[int, float]:
        raw = {t: (1 + np.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    def score(self, text: str | None, k: int, smoothing: float) -> tuple[float, list[int]]:
        counts = self.terms.count(text)
        if not counts:
            return self.silent, []
        found, cosines = self.nearest(self.vector(counts), k)
        votes = cosines * self.value[found]
        # the prior counts like a distant example, so lone weak neighbours decide little
        score = (float(votes @ self.toxic[found]) + smoothing * self.prior) / (float(votes.sum()) + smoothing)
        return min(1.0, max(0.0, score)), [int(i) for i in self.ids[found]]


def _build(terms: list[str], idf: np.ndarray, sample: pd.DataFrame, postings: pd.DataFrame,
           sizes: dict[int, int]) -> Index:
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    kept = sample.groupby("toxic")["doc_id"].count().to_dict()
    per = {y: sizes.get(y, 0) / n for y, n in kept.items()}
    known = Vocabulary(terms)
    place = known.place
    vectors: dict[int, dict[int, float]] = {}
    for doc_id, word, n in postings.itertuples(index=False):
        vectors.setdefault(int(doc_id), {})[place[word]] = (1 + np.log(n)) * idf[place[word]]
    label = dict(zip(sample["doc_id"].astype(int), sample["toxic"].astype(int), strict=True))
    # alike examples side by side, so that bounds of blocks are tight
    heavy = {d: (max(v, key=lambda t: (v[t], -t)), d) for d, v in vectors.items()}
    ids = sorted(vectors, key=heavy.__getitem__)
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, d in enumerate(ids):
        norm = np.sqrt(sum(v * v for v in vectors[d].values()))
        for t, v in vectors[d].items():
            lists[t].append((i, v / norm))
    out: dict[str, list[np.ndarray]] = {x: [] for x in ("blocks", "most", "starts", "docs", "weights")}
    for rows in lists:
        docs = np.array([i for i, _ in rows], np.int64)
        weights = np.array([w for _, w in rows])
        blocks, first = np.unique(docs // BLOCK, return_index=True)
        out["blocks"].append(blocks)
        out["starts"].append(np.append(first, len(docs)))
        out["most"].append(np.maximum.reduceat(weights, first) if len(docs) else weights)
        out["docs"].append(docs)
        out["weights"].append(weights)
    without = {y: sum(1 for d, l in label.items() if l == y and d not in vectors) * per.get(y, 0) for y in (0, 1)}
    return Index(
        known, idf, toxic=np.array([label[d] for d in ids], float),
        value=np.array([per[label[d]] for d in ids]) / max(per.values(), default=1.0),
        ids=np.array(ids, np.int64), prior=prior,
        silent=(without[1] + prior) / (without[0] + without[1] + 1), **out,
    )


def train(
    docs: DataFrame, labels: DataFrame, toxic_examples: int = 4_000, clean_examples: int = 12_000,
    max_terms: int = 4_096, least_gain: float = 20.0, least_share: float = 0.8,
) -> Index:
    """Fit on a sample of at most ``toxic_examples`` and ``clean_examples`` documents.

    Examples are the labelled, learnable documents of smallest hashed id; a
    doc_id labelled twice counts as toxic if any label says so, null labels and
    ids are left out.  ``least_gain`` is the likelihood-ratio statistic a term
    needs, ``least_share`` the share of toxic ones among the documents with it.  Without examples of both labels every score is the label's rate.
    """
    marks = (
        labels.where("toxic in (0, 1)").where(learnable(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marks.where("toxic = 1").orderBy(*by_hash).limit(toxic_examples).union(
        marks.where("toxic = 0").orderBy(*by_hash).limit(clean_examples)
    )
    chosen = docs.sparkSession.createDataFrame(sample.collect(), "doc_id long, toxic int")
    features = materialize(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(
            _sample_features,
            "doc_id long, toxic int, words array<string>, counts array<long>, mins array<long>",
        ).dropDuplicates(["doc_id"]).coalesce(8),  # a bounded table: few files
        "toxicity-sample",
    )
    kept = _distinct(features.select("doc_id", "mins").toPandas())
    kept_rows = docs.sparkSession.createDataFrame([(i,) for i in sorted(kept)], "doc_id long")
    features = features.join(F.broadcast(kept_rows), "doc_id")
    shown = features.select("doc_id", "toxic").toPandas()
    n1 = float((shown["toxic"] == 1).sum())
    rate = n1 / max(1.0, float(len(shown)))
    if not 0 < rate < 1:
        return _build([], np.empty(0), shown, pd.DataFrame(columns=["doc_id", "word", "n"]), sizes)

    each = {y: sizes[y] / float((shown["toxic"] == y).sum()) for y in (0, 1)}

    def gain(count: Column, share: float) -> Column:
        return F.when(count > 0, count * F.log(count / (F.col("n") * share))).otherwise(0.0)

    ranked = (
        features.select("toxic", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
        .where(F.col("a") * each[1] >= least_share * (F.col("a") * each[1] + (F.col("n") - F.col("a")) * each[0]))
        .withColumn("gain", 2 * (gain(F.col("a"), rate) + gain(F.col("n") - F.col("a"), 1 - rate)))
        .where(F.col("gain") >= least_gain)
        .orderBy(F.desc("gain"), "word").limit(max_terms).select("word")
    )
    terms = [r["word"] for r in ranked.collect()]
    places = docs.sparkSession.createDataFrame([(w,) for w in terms], "word string")
    postings = (
        features.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .select("doc_id", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        .join(F.broadcast(places), "word").select("doc_id", "word", "n").toPandas()
    )
    return _build(terms, _idf(docs, terms), shown, postings, sizes)


def _idf(docs: DataFrame, terms: list[str]) -> np.ndarray:
    """Smoothed inverse document frequency over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        seen: Counter = Counter()
        for batch in batches:
            seen[-1] += len(batch)
            for text in batch["text"]:
                seen.update(known.count(text).keys())
        yield pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())}, dtype="int64")

    counts = docs.select("text").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counts.collect()}
    df = np.array([found.get(i, 0) for i in range(len(terms))], float)
    return np.log((found.get(-1, 0) + 1) / (df + 1)) + 1


def scores(docs: DataFrame, index: Index, out: str, k: int = 16, smoothing: float = 0.1) -> DataFrame:
    """``docs`` with ``out``: a struct of ``score`` and ``evidence`` (ids of the voters, nearest first).

    A null or empty text holds no term; such texts score the rate of toxic
    labels among the examples without any.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("score double, evidence array<long>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for texts in batches:
            yield pd.DataFrame([index.score(t, k, smoothing) for t in texts], columns=["score", "evidence"])

    return docs.withColumn(out, judge("text"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every document."""
    return scores(docs.select("doc_id", "text"), train(docs, labels), "judged").select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True)).alias("held_out"),
        F.col("judged.score").alias("score"),
        (F.col("judged.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("judged.evidence").alias("evidence"),
    )
