"""Column helpers that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(values: Column, levels: int = 24) -> Column:
    """Sums of all values up to each, by doubling: n log n steps for n values; a level beyond the size costs one comparison."""
    def level(step: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) > step, F.transform(a, lambda x, i: x + F.when(i >= step, F.get(a, i - step)).otherwise(F.lit(0)))).otherwise(a)

    out = values
    for k in range(levels):
        out = let(out, level(1 << k))
    return out
