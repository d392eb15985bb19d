"""Cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary (all words of the documents, or the most
frequent ones where a size is asked for), order and smoothing; they differ in
what they count: the target documents, or all documents.  No task holds a
model.  Words are 64-bit hashes; texts are read in portions, whose distinct
bigrams are counted and dealt to buckets by their word.  Buckets, more of them
the larger the corpus, add up the counts and send them back, and the portions'
losses are summed by document.  What a word or bigram with
about a thousandth of all places or more adds is scored where the text is read,
from counts every task holds (there can only be about a thousand of them), so no
bucket is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .decontaminate import words_of

UNKNOWN, START = 0, 1
#: Words and bigrams with a share of one in so many places are counted ahead.
SHARE = 1_024
#: Places of the corpus to a bucket, and places a task holds while it deals them out.
BUCKET, PORTION = 1 << 20, 1 << 21
#: Words a task counts at a time, and words whose hashes it remembers.
_HELD, _KNOWN = 1_000_000, 1 << 18


def _rows(counts: list[tuple[bytes | None, int]]) -> pd.DataFrame:
    return pd.DataFrame(counts, columns=["word", "n"]).astype({"n": "int64"})


def _count(keep: int | None, only: Callable[[], frozenset[bytes]] | None = None):
    """Word counts of a task's texts, in portions of bounded memory.

    A portion hands on its ``keep`` most frequent words, and under no word the
    largest count it held back.
    """

    def portion(seen: Counter) -> pd.DataFrame:
        if keep is None or len(seen) <= keep:
            return _rows(list(seen.items()))
        top = seen.most_common(keep + 1)
        return _rows([*top[:keep], (None, top[keep][1])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = only() if only else None
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = words_of(text)
                seen.update(words if wanted is None else filter(wanted.__contains__, words))
                if len(seen) >= _HELD:
                    yield portion(seen)
                    seen = Counter()
        yield portion(seen)

    return run


def vocabulary(docs: DataFrame, size: int, spread: int = 16) -> list[bytes]:
    """The most frequent words of all of ``docs``, ties by word; ``size`` counts the two marks.

    Exact, without shuffling every rare word: tasks hand on their ``spread *
    size`` most frequent words, and the sum of what they held back bounds every
    count.  Words that may be among the most frequent are then counted in all
    documents.  Should a word held back reach that far too, all words are
    counted.
    """
    n = size - 2
    texts = docs.select("text")

    def summed(count) -> DataFrame:
        return texts.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def first(counts: DataFrame) -> list:
        return counts.orderBy(F.desc("n"), "word").limit(n).collect()

    some = materialize(summed(_count(spread * size)), "words")
    back = some.where("word is null").select("n").collect()
    back = back[0]["n"] if back else 0
    known = some.where("word is not null")
    least = [r["n"] for r in first(known)]
    if back and (len(least) < n or least[-1] <= back):
        return [bytes(r["word"]) for r in first(summed(_count(None)))]
    if back:
        floor = least[-1] - back
        # at most one word for each ``floor`` words of the texts, and never more than the tasks named
        close = frozenset(bytes(r["word"]) for r in known.where(F.col("n") >= floor).select("word").collect())
        shared = docs.sparkSession.sparkContext.broadcast(close)
        known = summed(_count(None, lambda: shared.value))
    return [bytes(r["word"]) for r in first(known)]


class _Codes(dict):
    """Hashes of words; those outside ``only`` are unknown."""

    def __init__(self, only: frozenset[bytes] | None) -> None:
        self.only = only

    def __missing__(self, word: bytes) -> int:
        code = UNKNOWN if self.only is not None and word not in self.only else xxhash.xxh64_intdigest(word)
        if len(self) < _KNOWN:
            self[word] = code
        return code


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = before * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += word
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


@dataclass
class _Places:
    """Documents, and the places of their words one after the other."""

    code: np.ndarray
    wanted: np.ndarray
    n: np.ndarray
    word: np.ndarray

    def __post_init__(self) -> None:
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        ends = np.cumsum(self.n)
        self.first, self.last = np.zeros(len(self.word), bool), np.zeros(len(self.word), bool)
        some = self.n > 0
        self.first[(ends - self.n)[some]] = True
        self.last[ends[some] - 1] = True
        before = np.concatenate((np.zeros(1, np.uint64), self.word[:-1]))[: len(self.word)]
        before[self.first] = START
        self.before = before
        self.pair = _pair(before, self.word)


def _places(batches: Iterator[pd.DataFrame], only: frozenset[bytes] | None) -> Iterator[_Places]:
    """Portions of bounded size, apart from what a single document exceeds it by."""
    codes, held, n = _Codes(only), [], 0

    def portion() -> _Places:
        code, wanted, words = zip(*held, strict=True)
        return _Places(
            np.array(code, np.int64), np.array(wanted, bool), np.array([len(w) for w in words], np.int64),
            np.concatenate(words),
        )

    for batch in batches:
        for code, wanted, text in zip(batch["code"], batch["wanted"], batch["text"], strict=True):
            words = words_of(text)
            held.append((code, wanted, np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))))
            n += len(words)
            if n >= PORTION or len(held) >= PORTION:
                yield portion()
                held, n = [], 0
    if held:
        yield portion()


def _find(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted ``among``, -1 where it is not."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _frequent(keyed: DataFrame, only, share: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of frequent words and of frequent bigrams, sorted, and the number of distinct words.

    A portion names what has one in ``share`` of its places.  What the portions
    that name it count together reaches that share of all places for ``share``
    words and bigrams at most, and all others stay below twice that share.  A
    frequent bigram is of frequent words.  Distinct words meet by ranges of
    hashes, more of them the more documents there are.
    """

    parts = max(1, keyed.count() >> 12)
    bounds = np.array([(i << 64) // parts for i in range(parts)], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _places(batches, only()):
            rows = []
            for kind, values in enumerate((p.word, p.pair)):
                each, n = np.unique(values, return_counts=True)
                n[n * share < max(1, len(values))] = 0
                if kind:
                    each, n = each[n > 0], n[n > 0]
                ends = [*np.searchsorted(each, bounds).tolist(), len(each)]
                for part, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if y > x:
                        often = np.flatnonzero(n[x:y]).astype(np.int32)
                        rows.append((kind, part, each[x:y].tobytes(), often.tobytes(), n[x:y][often].tobytes()))
            size = np.array([len(p.word)])
            rows.append((4, 0, np.zeros(1, np.uint64).tobytes(), np.zeros(1, np.int32).tobytes(), size.tobytes()))
            yield pd.DataFrame(rows, columns=["kind", "part", "codes", "often", "n"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        codes = [np.frombuffer(b, np.uint64) for b in rows["codes"]]
        often = np.concatenate([c[np.frombuffer(b, np.int32)] for c, b in zip(codes, rows["often"], strict=True)])
        n = np.concatenate([np.frombuffer(b, np.int64) for b in rows["n"]])
        kind = int(rows["kind"].iloc[0])
        out = pd.DataFrame({"kind": kind, "k": often.view(np.int64), "n": n}).groupby(["kind", "k"], as_index=False).sum()
        distinct = len(np.unique(np.concatenate(codes)))
        return pd.concat([out, pd.DataFrame({"kind": [2 + kind], "k": [0], "n": [distinct]})])

    seen = materialize(
        keyed.mapInPandas(run, "kind int, part int, codes binary, often binary, n binary")
        .groupBy("kind", "part").applyInPandas(merge, "kind int, k long, n long"),
        "frequent",
    )
    distinct = seen.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    places = seen.where("kind = 4").agg(F.sum("n")).first()[0] or 0
    named = seen.where("kind < 2").where(F.col("n") * share >= places).collect()
    words, pairs = (np.sort(np.array([r["k"] for r in named if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1))
    return words, pairs, distinct


@dataclass
class _Ahead:
    """Counts every task holds: totals and those of frequent words and bigrams, target first."""

    words: np.ndarray
    pairs: np.ndarray
    n: np.ndarray  # 2 x words
    context: np.ndarray  # 2 x words: how often another word follows
    pair_n: np.ndarray  # 2 x pairs
    places: np.ndarray
    docs: np.ndarray  # with a word
    size: int
    weight: float

    def single(self, n: np.ndarray, model: int) -> np.ndarray:
        """``weight`` times the probability of a word that stands ``n`` times."""
        return self.weight * (n + 0.5) / (self.places[model] + 0.5 * self.size)


def _count_ahead(keyed: DataFrame, only, words: np.ndarray, pairs: np.ndarray, size: int, weight: float) -> _Ahead:
    """Exact counts of the frequent words and bigrams, and totals."""
    w, q = len(words), len(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 2 * w + q + 2), np.int64)
        for p in _places(batches, only()):
            at, pair = _find(words, p.word), _find(pairs, p.pair)
            for m, own in enumerate((p.wanted[p.doc], np.ones(len(p.word), bool))):
                sums[m, :w] += np.bincount(at[own & (at >= 0)], minlength=w)[:w]
                sums[m, w : 2 * w] += np.bincount(at[own & (at >= 0) & ~p.last], minlength=w)[:w]
                sums[m, 2 * w : 2 * w + q] += np.bincount(pair[own & (pair >= 0)], minlength=q)[:q]
                sums[m, -2] += own.sum()
                sums[m, -1] += (p.first & own).sum()
        yield pd.DataFrame({"at": np.arange(sums.shape[1]), "target": sums[0], "background": sums[1]})

    rows = (
        keyed.mapInPandas(run, "at long, target long, background long")
        .groupBy("at").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).collect()
    )
    sums = np.zeros((2, 2 * w + q + 2), np.int64)
    for r in rows:
        sums[:, r["at"]] = r["target"], r["background"]
    return _Ahead(
        words, pairs, sums[:, :w], sums[:, w : 2 * w], sums[:, 2 * w : 2 * w + q], sums[:, -2], sums[:, -1], size, weight
    )


_DEALT = "bucket int, base long, keys binary, ints binary, docs binary"


def _small(*arrays: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as they need, bytes of one weight together, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, "<i8")
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        out.append(np.array([len(a), width], "<u4").tobytes())
        out.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.compress(b"".join(out), 1)


def _large(packed: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(packed), 0, []
    while at < len(data):
        n, width = np.frombuffer(data, "<u4", 2, at).tolist()
        held = np.zeros((n, 8), np.uint8)
        held[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(width, n).T
        out.append(held.view("<i8").ravel())
        at += 8 + n * width
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small in size and from 0 on."""
    d = np.diff(a, prepend=0)
    return np.where(d < 0, -2 * d - 1, 2 * d)


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(steps & 1, -((steps + 1) >> 1), steps >> 1))


#: Bytes of a bigram beside those of its word.
_LOW = 6


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _deal(only, ahead, buckets: int):
    """Distinct bigrams of each portion and their counts by bucket, and the documents they stand in.

    Once a portion, in a row without ``ints``, go the lengths of its documents
    and what is scored ahead.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: _Ahead = ahead()
        task = TaskContext.get().partitionId()
        for turn, p in enumerate(_places(batches, only())):
            base = task << 22 | turn
            at, pair = _find(known.words, p.word), _find(known.pairs, p.pair)
            n = len(p.code)
            sums = [p.n.astype(float)]
            for m in (0, 1):
                loss = np.zeros(len(p.word))
                own = pair >= 0
                loss[own] = -np.log(known.pair_n[m][pair[own]] + known.single(known.n[m][at[own]], m))
                own = (at >= 0) & ~p.last
                loss[own] += np.log(known.context[m][at[own]] + known.weight)
                loss[p.first] += np.log(known.docs[m] + known.weight)
                sums.append(np.bincount(p.doc, loss, n))
            rows = [((task + turn) % buckets, base, p.code.tobytes(), b"", np.array(sums).tobytes())]
            left = np.flatnonzero(pair < 0)
            bucket = (np.where(at[left] >= 0, p.pair[left], p.word[left]) >> np.uint64(20)) % np.uint64(buckets)
            order = np.lexsort((p.pair[left], p.word[left], bucket))
            left, bucket = left[order], bucket[order].astype(np.int64)
            # the bigrams of a word by the first document they stand in: documents differ little from place to place
            runs = _starts(bucket, p.word[left], p.pair[left]) if len(left) else left
            order = np.lexsort((p.doc[left[runs]], p.word[left[runs]], bucket[runs]))
            sizes = np.diff(runs, append=len(left))[order]
            left = left[np.repeat(runs[order] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(left))]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                mine = left[ends[b] : ends[b + 1]]
                wanted, goes_on = p.wanted[p.doc[mine]], ~p.last[mine]
                pairs, words = _starts(p.word[mine], p.pair[mine]), _starts(p.word[mine])
                low = p.pair[mine[pairs]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW]
                each = lambda of, starts: np.add.reduceat(of.astype(np.int64), starts)
                rows.append((
                    b, base, p.word[mine[words]].tobytes() + low.tobytes(),
                    _small(
                        np.diff(np.searchsorted(pairs, words), append=len(pairs)),
                        np.diff(pairs, append=len(mine)), each(wanted, pairs),
                        each(goes_on, words), each(goes_on & wanted, words),
                    ),
                    _small(_steps(p.doc[mine]), np.packbits(~goes_on)),
                ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DEALT.split(", ")])

    return run


def _total(ahead):
    """Counts in all documents of the bigrams and words of one bucket, for each portion in the order it sent them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known: _Ahead = ahead()
        direct = rows["ints"].map(len) == 0
        passed, rows = rows.loc[direct, ["base", "keys", "ints", "docs"]], rows[~direct]
        if not len(rows):
            return passed
        sent = [_large(ints) for ints in rows["ints"]]
        runs = [r[0] for r in sent]
        words = [np.frombuffer(k, np.uint64, len(r)) for k, r in zip(rows["keys"], runs, strict=True)]
        pairs = []
        for k, r, w in zip(rows["keys"], runs, words, strict=True):
            low = np.zeros((int(r.sum()), 8), np.uint8)
            low[:, :_LOW] = np.frombuffer(k, np.uint8, offset=8 * len(r)).reshape(-1, _LOW)
            pairs.append(_pair(low.view("<u8").ravel(), np.repeat(w, r)))
        each, word = np.unique(np.concatenate(words), return_inverse=True)
        pair = np.unique(np.concatenate(pairs), return_inverse=True)[1]
        of_pair = np.repeat(word, np.concatenate(runs))
        at = _find(known.words, each)
        ours = []
        for m, (n, follow) in enumerate(((2, 4), (1, 3))):  # target first
            n, follow = (np.concatenate([r[i] for r in sent]) for i in (n, follow))
            single = np.where(at >= 0, known.n[m][at] if len(known.words) else 0, np.bincount(of_pair, n))
            # one more than counted; 0 is the context of a frequent word, scored ahead
            context = np.where(at >= 0, 0, 1 + np.bincount(word, follow))
            ours.append((np.bincount(pair, n)[pair], single[word], context[word]))
        out, x, y = [], 0, 0
        for base, r, own, docs in zip(rows["base"], runs, (s[1] for s in sent), rows["docs"], strict=True):
            p, w = slice(x, x + int(r.sum())), slice(y, y + len(r))
            x, y = p.stop, w.stop
            told = [v[part] for counts in ours for v, part in zip(counts, (p, w, w), strict=True)]
            out.append((base, b"", _small(r, own, *told), docs))
        return pd.concat([passed, pd.DataFrame(out, columns=passed.columns)])

    return run


def _gather(ahead):
    """Sums of the documents of one portion, from what its buckets and the scan hand on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known: _Ahead = ahead()
        direct = rows["ints"].map(len) == 0
        first = rows[direct].iloc[0]
        n, *sums = np.frombuffer(first["docs"]).reshape(3, -1).copy()
        for ints, docs in zip(rows["ints"][~direct], rows["docs"][~direct], strict=True):
            runs, own, *told = _large(ints)
            doc, last = _large(docs)
            doc = _summed(doc)
            goes_on = np.unpackbits(last.astype(np.uint8), count=len(doc)) == 0
            word = np.repeat(np.arange(len(runs)), runs)
            for m, (pair, single, context) in enumerate((told[:3], told[3:])):
                loss = np.repeat(-np.log(pair + known.single(single, m)[word]), own)
                follow = np.zeros(len(runs))
                some = context > 0
                follow[some] = np.log(context[some] - 1 + known.weight)
                loss += np.where(goes_on, np.repeat(follow[word], own), 0)
                sums[m] += np.bincount(doc, loss, len(n))
        return pd.DataFrame({"code": np.frombuffer(first["keys"], np.int64), "n": n.astype(np.int64), "t": sums[0], "b": sums[1]})

    return run


def _marked(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """``keyed`` with ``wanted``, whether the doc_id is a target.

    Only ids are shuffled: targets come back as one bit per row, 64 rows to a
    number, written so that Spark knows their size.  Below its threshold (10 MB
    are some 40 million rows) they travel to the texts, beyond it the texts are
    shuffled to meet them.
    """
    block, bit = F.shiftright("place", 6), (F.col("place") % 64).cast("int")
    wanted = targets.select("doc_id").where("doc_id is not null")
    bits = materialize(
        keyed.select("doc_id", "place").join(wanted, "doc_id", "left_semi")
        .groupBy(block.alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")),
        "targets",
    )
    marked = keyed.withColumn("block", block).join(bits, "block", "left")
    return marked.withColumn("wanted", F.coalesce(F.getbit("bits", bit) == 1, F.lit(False)))


def score_documents(
    docs: DataFrame, targets: DataFrame, size: int | None = None, weight: float = 20.0, share: int = SHARE
) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every row of ``docs``.

    ``targets`` holds the doc_ids of the target documents; repeats and nulls in
    it count nothing.  Losses are nats per word, the score is target loss less
    background loss: the lower, the more a document is like the target.  A text
    without words (or null) has losses and score 0.  Rows of ``docs`` that share
    a doc_id are all scored and counted.

    Bigrams fall back on unigrams with ``weight`` pseudo-counts, unigrams on the
    uniform distribution with half a count each.  The vocabulary is all words
    and two marks, or with ``size`` so many of the most frequent, others being
    ``<unk>``.
    """
    spark = docs.sparkSession
    # rows of one code have one doc_id and text, so one result
    keyed = docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("code"), F.monotonically_increasing_id().alias("place")
    )
    path = scratch_path(spark, "keyed")
    keyed.write.option("compression", "zstd").parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    shared = size and spark.sparkContext.broadcast(frozenset(vocabulary(docs, size)))
    only = lambda: shared.value if shared else None
    texts = _marked(keyed, targets).select("code", "wanted", "text")
    words, pairs, distinct = _frequent(texts, only, share)
    held = spark.sparkContext.broadcast(_count_ahead(texts, only, words, pairs, size or distinct + 2, weight))
    ahead = lambda: held.value
    buckets = -(-int(held.value.places[1]) // BUCKET) or 1
    sums = (
        texts.mapInPandas(_deal(only, ahead, buckets), _DEALT)
        .groupBy("bucket").applyInPandas(_total(ahead), "base long, keys binary, ints binary, docs binary")
        .groupBy("base").applyInPandas(_gather(ahead), "code long, n long, t double, b double")
        # rows of one code have equal sums
        .groupBy("code").agg(F.min(F.struct("n", "t", "b")).alias("s"))
    )
    mean = lambda c: F.when(F.col("s.n") > 0, F.col(f"s.{c}") / F.col("s.n")).otherwise(0.0)
    return (
        keyed.select("doc_id", "code").join(sums, "code")
        .select("doc_id", F.col("s.n").alias("n_words"), mean("t").alias("target_loss"), mean("b").alias("background_loss"))
        .withColumn("score", F.col("target_loss") - F.col("background_loss"))
    )
