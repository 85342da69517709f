"""Column expressions over arrays: contiguous sub-lists and multisets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a variable, so that what is used often is computed once and stands once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(needle: Column, hay: Column) -> Column:
    """The 0-based positions at which needle is a contiguous part of hay; an empty needle is at every position."""
    head, rest = F.get(needle, F.lit(0)), F.size(needle)
    # most positions fail at their first element, before anything is copied
    found = F.filter(F.transform(hay, lambda x, i: F.when(x.eqNullSafe(head) & (F.slice(hay, i + 1, rest) == needle), i)), lambda i: i.isNotNull())
    return F.when(rest == 0, F.sequence(F.lit(0), F.size(hay))).otherwise(found)


def sublist_position(needle: Column, hay: Column) -> Column:
    """Where needle first begins in hay (0-based); 0 for an empty needle, -1 where it isn't found."""
    return F.when(F.size(needle) == 0, F.lit(0)).otherwise(F.coalesce(F.get(_starts(needle, hay), F.lit(0)), F.lit(-1)))


def last_sublist_position(needle: Column, hay: Column) -> Column:
    """Where needle last begins in hay (0-based), -1 where it isn't found."""
    return F.coalesce(F.try_element_at(_starts(needle, hay), F.lit(-1)), F.lit(-1))


def contains_sublist(needle: Column, hay: Column) -> Column:
    return sublist_position(needle, hay) >= 0


def overlap_count(a: Column, b: Column) -> Column:
    """The size of the intersection of two multisets: both are sorted together, and each run of equal elements gives what both sides have of it. Nulls count for nothing."""
    side = lambda x, k: F.transform(F.filter(x, lambda t: t.isNotNull()), lambda t: F.struct(t.alias("t"), F.lit(k).alias("k")))
    state = lambda t, p, q, n: F.struct(t.alias("t"), p.alias("p"), q.alias("q"), n.alias("n"))

    def step(acc: Column, x: Column) -> Column:
        same, first, second = acc["t"].eqNullSafe(x["t"]), 1 - x["k"], x["k"]
        return state(x["t"], F.when(same, acc["p"]).otherwise(0) + first, F.when(same, acc["q"]).otherwise(0) + second, F.when(same, acc["n"]).otherwise(acc["n"] + F.least(acc["p"], acc["q"])))

    zero = state(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), zero, step, lambda acc: acc["n"] + F.least(acc["p"], acc["q"]))


def first_where(values: Column, condition) -> Column:
    """The first element for which the condition holds, or null."""
    return F.get(F.filter(values, condition), F.lit(0))

