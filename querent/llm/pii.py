r"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans come from fixed regular expressions and checks.  They are the seeds:
the words around them induce lexical patterns, and patterns and instances form a
graph whose scores Spark sums round by round.  A pattern is as good as its
instances; an instance that misses the base form but looks like its kind is as
good as the patterns it stands in, and good ones join the found spans.

Expressions and joins of DataFrames only.  Texts are read once and not
shuffled: what moves are the few spans, their contexts and their scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, once, prefix_sums
from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's expressions.  Possessive loops and the look-behinds (or the
#: end of the last match, \G) change no match: they keep a long run of one class
#: from being tried again from each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an instance without having the base form.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "ip": BASE["ip"],
    "card": BASE["card"],
    "phone": r"(?<![0-9+.-])\(?[0-9][\x20().0-9-]*[0-9]",
}
_PLACE = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _located(text: Column, pattern: str) -> Column:
    """Matches with their places in code points and the text up to the next match."""

    def build(s: Column) -> Column:
        steps = F.transform(
            s["pieces"],
            lambda p, i: F.length(p) + F.when(i > 0, F.length(F.get(s["hits"], i - 1))).otherwise(0),
        )
        return bind(
            prefix_sums(steps),
            lambda ends: F.transform(
                s["hits"],
                lambda h, i: F.struct(
                    F.get(ends, i + 1).alias("start"), (F.get(ends, i + 1) + F.length(h)).alias("end"),
                    h.alias("value"),
                    F.substring(F.get(s["pieces"], i), -40, 40).alias("left"),
                    F.substring(F.get(s["pieces"], i + 1), 1, 40).alias("right"),
                ),
            ),
        )

    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )
    return bind(found, build).cast(_PLACE)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _between(value: Column, low: int, high: int) -> Column:
    n = F.length(_digits(value))
    return (n >= low) & (n <= high)


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small_part),
    "card": lambda v: F.when(_between(v, 12, 19), bind(_digits(v), _luhn)).otherwise(False),
    "phone": lambda v: _between(v, 9, 15),
}
PLAUSIBLE = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.lit(True),
    "card": lambda v: _between(v, 12, 19),
    "phone": lambda v: _between(v, 9, 15),
}


def _contexts(place: Column) -> Column:
    """Lexical patterns around a place: two words before it; one on either side.

    A side without words makes no pattern.
    """
    tidy = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    left, right = tidy(place["left"]), tidy(place["right"])
    two = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    before, after = F.regexp_extract(left, r"(\S+)\s*$", 1), F.regexp_extract(right, r"^\s*(\S+)", 1)
    return F.array_compact(F.array(
        F.when(two != "", F.concat(F.lit("before "), two)),
        F.when((before != "") & (after != ""), F.concat(F.lit("around "), before, F.lit(" _ "), after)),
    ))


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, code, base, marks`` of every row.

    ``base`` are the base spans (start, kind, end), ``marks`` seeds and
    candidates (kind, start, end, value, seed, contexts); ``code`` hashes the
    text.
    """
    text = F.coalesce("text", F.lit(""))
    digit = text.rlike("[0-9]")
    near = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    loose = {"email": near["email"] | text.rlike(r"[\[(]at[\])]"), "ip": digit, "card": digit, "phone": digit}

    def places(where: Column, pattern: str, ok: Callable[[Column], Column]) -> Column:
        found = F.filter(_located(text, pattern), lambda p: ok(p["value"]))
        return F.when(where, found).otherwise(F.array().cast(_PLACE))

    def spans(kind: int) -> Column:
        return F.transform(KINDS[kind], lambda p: F.struct(
            p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")
        ))

    rows = once(
        docs.select("doc_id", "text"),
        code=F.xxhash64("text"),
        **{k: places(near[k], BASE[k], VALID[k]) for k in KINDS},
        **{f"{k}_like": places(loose[k], LOOSE[k], PLAUSIBLE[k]) for k in KINDS},
    ).drop("text")
    base = F.array_sort(F.flatten(F.array(*map(spans, range(len(KINDS)))))).cast(_SPAN)
    rows = once(rows, base=base)

    def marks(kind: int, places: Column, seed: bool) -> Column:
        return F.transform(places, lambda p: F.struct(
            F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
            F.lower(p["value"]).alias("value"), F.lit(seed).alias("seed"), _contexts(p).alias("contexts"),
        ))

    # candidates share no character with a base span and are no part of a longer token
    apart = lambda places: F.filter(places, lambda p: ~(
        F.exists("base", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))
        | p["left"].rlike("[0-9A-Za-z]$") | p["right"].rlike("^[0-9A-Za-z]")
    ))
    every = [marks(i, F.col(k), True) for i, k in enumerate(KINDS)]
    every += [marks(i, apart(F.col(f"{k}_like")), False) for i, k in enumerate(KINDS)]
    return rows.select("doc_id", "code", "base", F.flatten(F.array(*every)).alias("marks"))


def score_instances(
    found: DataFrame, rounds: int = 3, least_seeds: int = 5, least_confidence: float = 0.9, least_patterns: int = 2
) -> DataFrame:
    """``kind, value, score`` of the candidates accepted, by ``rounds`` over the graph.

    A pattern's confidence is the sum of its instances' scores over their number
    plus one; it counts from ``least_seeds`` good instances and
    ``least_confidence`` on.  A candidate needs ``least_patterns`` such patterns;
    its score is the chance that not all of them err.
    """
    edges = materialize(
        found.select(F.explode("marks").alias("m"))
        .select("m.kind", "m.value", "m.seed", F.explode(F.array_distinct("m.contexts")).alias("pattern"))
        .groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")),
        "pattern-graph",
    )
    seeds = edges.where("seed").select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for _ in range(rounds):
        patterns = (
            edges.join(scores, ["kind", "value"], "left").groupBy("kind", "pattern")
            .agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"))
            .withColumn("confidence", F.col("good") / (F.col("n") + 1))
            .where((F.col("good") >= least_seeds) & (F.col("confidence") >= least_confidence))
        )
        scores = materialize(
            seeds.union(
                edges.where("not seed").join(patterns, ["kind", "pattern"]).join(seeds, ["kind", "value"], "left_anti")
                .groupBy("kind", "value")
                .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= least_patterns).select("kind", "value", "score")
            ),
            "instances",
        )
    return scores.join(seeds, ["kind", "value"], "left_anti")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_<kind>, base_sha256, spans`` of every row of ``docs``.

    Counts and ``base_sha256`` are of the base spans; ``spans`` lists these and
    the discovered ones, by start, kind and end.  A null text is empty; repeated
    rows are all returned.
    """
    found = materialize(find_spans(docs), "spans")
    accepted = score_instances(found)
    added = (
        found.select("doc_id", "code", F.explode("marks").alias("m")).where("not m.seed")
        .select("doc_id", "code", "m.kind", "m.value", "m.start", "m.end")
        .join(accepted, ["kind", "value"])
        .groupBy("doc_id", "code")
        .agg(F.collect_set(F.struct("start", "kind", "end")).cast(_SPAN).alias("added"))
        .select(F.col("doc_id").alias("_id"), F.col("code").alias("_code"), "added")
    )
    both = found.join(added, found["doc_id"].eqNullSafe(added["_id"]) & (found["code"] == added["_code"]), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast(_SPAN))))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return both.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
    )
