"""Small idioms for arrays inside one row.

Per-document work stays inside the row: splitting a text, flagging lines and
joining them again is a narrow projection, so a corpus is read once and never
shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A lambda that mentions an outer expression would recompute it for every
    element; a lambda variable is a plain reference.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row.

    Later filters on a plain column would pull its expression below and compute
    it again; a generated column stays where it is.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def last(arr: Column) -> Column:
    return F.get(arr, F.size(arr) - 1)


def _running(values: Column, start: Column) -> Column:
    return F.aggregate(values, F.array(start), lambda acc, v: F.concat(acc, F.array(last(acc) + v)))


def in_pieces(values: Column, root: int = 2) -> Column:
    """The array cut into as many pieces as the ``root`` of its length; one empty piece of nothing."""
    pieces = F.greatest(F.ceil(F.pow(F.size(values), F.lit(1 / root))), F.lit(1))
    width = F.greatest(F.ceil(F.size(values) / pieces), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / width), F.lit(1)).cast("int") - 1)
    return F.transform(starts, lambda i: F.slice(values, i * width + 1, width))


def fold_out(
    values: Column, kind: str, start: dict[str, Column], step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column], levels: int = 3,
) -> Column:
    """Array of all that a fold puts out, elements of type ``kind``.

    ``step(state, value)`` is a struct of the array ``put`` and the fields of
    ``start``, in that order; ``finish(state)`` is the array of what is left.
    A fold copies its accumulator for every value.  So steps never see what was
    put out; it is gathered by pieces of pieces, and a value's share of copying
    is ``levels`` times half that root of the number of values.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def gathered(out: Column, now: Column) -> Column:
        return F.struct(out.alias("out"), now.alias("now"))

    def fold(part: Column, now: Column, level: int) -> Column:
        if level == 1:
            # a step behind: the state is evaluated once, and what it put out joins with the next value
            return F.aggregate(
                part, gathered(none, now),
                lambda acc, v: gathered(F.concat(acc["out"], acc["now"]["put"]), step(acc["now"], v)),
            )
        return F.aggregate(
            in_pieces(part, level),
            F.struct(none.alias("out"), gathered(none, now).alias("last")),
            lambda acc, piece: F.struct(
                F.concat(acc["out"], acc["last"]["out"]).alias("out"), fold(piece, acc["last"]["now"], level - 1).alias("last")
            ),
            lambda acc: gathered(F.concat(acc["out"], acc["last"]["out"]), acc["last"]["now"]),
        )

    first = F.struct(none.alias("put"), *[c.alias(n) for n, c in start.items()])
    return bind(values, lambda all_: bind(
        fold(all_, first, levels), lambda end: F.concat(end["out"], end["now"]["put"], finish(end["now"]))
    ))


def prefix_sums(values: Column) -> Column:
    """Running totals starting at 0: one entry more than ``values``.

    Long arrays go in pieces of about the square root of their length, so that
    no growing array is copied for every element of the whole.
    """
    zero = F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda acc, v: acc + v)

    def pieces(all_: Column) -> Column:
        return bind(in_pieces(all_), lambda parts: bind(_running(F.transform(parts, total), zero), lambda starts: F.concat(
            F.flatten(F.transform(parts, lambda p, i: bind(
                _running(p, F.get(starts, i)), lambda sums: F.slice(sums, 1, F.size(sums) - 1)
            ))),
            F.array(last(starts)),
        )))

    return bind(
        F.transform(values, lambda v: v.cast("bigint")),
        lambda all_: F.when(F.size(all_) <= 64, _running(all_, zero)).otherwise(pieces(all_)),
    )


def top_by_count(found: Column, k: int | None) -> Column:
    """Distinct strings by falling frequency, ties by first occurrence; the first ``k`` or all.

    Equal strings stand together once sorted, so the work grows with the number
    of strings, not with its square.
    """

    def ranked(s: Column) -> Column:
        begins = F.filter(
            F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, F.greatest(i - 1, F.lit(0)))["w"])
        )
        return bind(begins, lambda at: F.array_sort(F.transform(at, lambda a, j: F.struct(
            (a - F.coalesce(F.get(at, j + 1), F.size(s))).alias("c"), F.get(s, a)["i"].alias("i"), F.get(s, a)["w"].alias("w")
        ))))

    sorted_ = F.array_sort(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    some = bind(sorted_, lambda s: ranked(s) if k is None else F.slice(ranked(s), 1, k))
    return F.transform(some, lambda s: s["w"])
