"""Recurrences within one row, as folds over arrays: no shuffle, no Python.

A fold that gathers a list copies it at every item. ``scan`` gathers in blocks of the square root of the length, so an
array of n items costs about n ** 1.5 copies of a reference: a million segments take seconds, not hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items up to which a fold gathers in one block.
BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(
    items: Column, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]],
    finish: Callable[[Column, Column], Column] = lambda out, state: out,
) -> Column:
    """The lists that ``step`` gives along ``items``, end to end, as array<kind>; null for a null array.

    ``step`` takes the state (a struct) and an item, and gives the next state's fields and an array of what is out;
    ``finish`` takes all that is out and the last state.
    """

    def fields(s) -> list[Column]:
        return [s[name].alias(name) for name in state]

    def within(part: Column, s: Column) -> Column:
        def one(held: Column, item: Column) -> Column:
            after, out = step(held, item)
            return F.struct(F.concat(held["out"], out).alias("out"), *fields(after))

        return F.aggregate(part, F.struct(F.array().cast(f"array<{kind}>").alias("out"), *fields(s)), one)

    def whole(items: Column) -> Column:
        n = F.size(items)
        block = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
        blocks = F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def one(held: Column, k: Column) -> Column:
            return let(within(F.slice(items, k * block + 1, block), held), lambda r: F.struct(F.concat(held["outs"], F.array(r["out"])).alias("outs"), *fields(r)))

        first = [c.alias(name) for name, c in state.items()]
        zero = F.struct(F.array().cast(f"array<array<{kind}>>").alias("outs"), *first)
        short = let(within(items, F.struct(*first)), lambda s: finish(s["out"], s))
        return F.when(n <= BLOCK, short).when(items.isNotNull(), F.aggregate(blocks, zero, one, lambda s: finish(F.flatten(s["outs"]), s)))

    return let(items, whole)


def greedy_starts(counts: Column, budget: Column | int) -> Column:
    """0-based starts of the greedy runs whose sums stay within the budget, at least one item each."""
    budget = F.lit(budget)

    def step(s: Column, c: Column) -> tuple[dict[str, Column], Column]:
        joins = (s["i"] > 0) & (s["sum"] + c <= budget)
        after = {"sum": F.when(joins, s["sum"] + c).otherwise(c).cast("long"), "i": s["i"] + 1}
        return after, F.when(joins, F.array().cast("array<int>")).otherwise(F.array(s["i"]))

    return scan(counts, "int", {"sum": F.lit(0).cast("long"), "i": F.lit(0)}, step)


def group_slices(items: Column, starts: Column, make) -> Column:
    """``make(slice, k, start)`` for the stretch of ``items`` from each start to the next."""

    def cut(items: Column, starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(items))
            return let(F.slice(items, start + 1, end - start), lambda part: make(part, k, start))

        return F.transform(starts, one)

    return let(items, lambda i: let(starts, lambda s: cut(i, s)))


def running_sums(values: Column, kind: str = "int") -> Column:
    """The sum of all values before each one."""
    return scan(values, kind, {"sum": F.lit(0).cast(kind)}, lambda s, v: ({"sum": (s["sum"] + v).cast(kind)}, F.array(s["sum"])))


def budget_breaks(tokens: Column, breaks: Column, hard: int) -> Column:
    """``breaks`` (one flag between neighbours) with a break added wherever the running sum would pass ``hard``.

    The sum starts anew at each break; 0 adds none.
    """
    if hard <= 0:
        return breaks

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        own = x["own"].cast("long")
        broken = x["flag"] | (s["sum"] + own > hard)
        return {"sum": F.when(broken, own).otherwise(s["sum"] + own)}, F.array(broken)

    pairs = F.transform(breaks, lambda flag, i: F.struct(flag.alias("flag"), F.get(tokens, i + 1).alias("own")))
    return scan(pairs, "boolean", {"sum": F.get(tokens, F.lit(0)).cast("long")}, step)


def first_of(items: Column, *keys: Callable[[Column], Column]) -> Column:
    """Items without later ones of the same keys, in their order. Sorted, not held against each other: n items cost
    n log n, whatever their keys."""

    def marked(items: Column) -> Column:
        names = [f"k{j}" for j in range(len(keys))]
        ranked = F.sort_array(F.transform(items, lambda x, i: F.struct(*[k(x).alias(name) for k, name in zip(keys, names)], i.alias("i"))))

        def leads(r: Column) -> Column:
            def new(x: Column, j: Column) -> Column:
                before = F.get(r, j - 1)
                same = j > 0
                for name in names:
                    same = same & x[name].eqNullSafe(before[name])
                return ~same

            return F.transform(F.sort_array(F.transform(F.filter(r, new), lambda x: x["i"])), lambda i: F.get(items, i))

        return F.when(F.size(items) < 2, items).otherwise(let(ranked, leads))

    return let(items, marked)


def counted(values: Column) -> Column:
    """array<struct<v, n>>: how often each value occurs, in the order of values."""

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda v, i: F.when((i == 0) | (v != F.get(ordered, i - 1)), i)))

        def one(starts: Column) -> Column:
            return F.transform(starts, lambda a, k: F.struct(F.get(ordered, a).alias("v"), (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - a).alias("n")))

        return let(starts, one)

    return let(F.sort_array(values), runs)


def spaced(indices: Column, min_distance: int) -> Column:
    """Indices kept from left to right at least ``min_distance`` after the last one kept."""

    def step(s: Column, i: Column) -> tuple[dict[str, Column], Column]:
        i = i.cast("int")
        keeps = s["last"].isNull() | (i >= s["last"] + min_distance)
        return {"last": F.when(keeps, i).otherwise(s["last"])}, F.when(keeps, F.array(i)).otherwise(F.array().cast("array<int>"))

    return scan(indices, "int", {"last": F.lit(None).cast("int")}, step)


def interpolated_percentile(values: Column, p: float) -> Column:
    """Linear interpolation at p * (n - 1) in the sorted values."""

    def between(ordered: Column) -> Column:
        at = F.lit(min(1.0, max(0.0, p))) * (F.size(ordered) - 1)
        low = F.floor(at).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
        return a + (b - a) * (at - low)

    return let(F.array_sort(values), between)
