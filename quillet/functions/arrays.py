"""Array helpers in expressions: one evaluation of a value, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column) -> Column:
    """Running sums of an array of longs: inside blocks of 128, over the sums of the blocks before, so long arrays aren't summed anew for each place."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)

    def summed(blocks: Column) -> Column:
        before = let(F.transform(blocks, total), lambda t: F.transform(t, lambda _, i: total(F.slice(t, F.lit(1), i))))
        inner = lambda b, base: F.transform(b, lambda _, j: base + total(F.slice(b, F.lit(1), j + 1)))
        return let(before, lambda bases: F.flatten(F.transform(blocks, lambda b, i: inner(b, F.get(bases, i)))))

    def blocked(a: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 128).cast("int"))
        return F.when(F.size(a) > 0, let(F.transform(starts, lambda b: F.slice(a, b * 128 + 1, F.lit(128))), summed)).otherwise(F.array().cast("array<bigint>"))

    return let(steps, blocked)
