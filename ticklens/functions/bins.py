"""Equal-width price bins without a range join.

The reference assigns rows to bins with a theta join (``p >= start AND p <
end``).  Here each row computes its candidate bin ``floor((p - lo) / w)`` and
checks the neighbouring bins ``k-1, k, k+1`` against the *same* boundary
formulas the predicate uses, so floating-point edge cases (a price exactly on
an edge, the maximum price) land where the predicate puts them.  The result is
a hash aggregate on a bin number plus a tiny join with ``range(n)`` that keeps
empty bins.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BoundFn = Callable[[Column], Column]


def matching_bins(value: Column, lo: Column, width: Column, n: int,
                  start: BoundFn, end: BoundFn, closed_last: bool = False) -> Column:
    """Array of bin numbers k in [0, n) with start(k) <= value < end(k)
    (last bin closed on the right when ``closed_last``)."""
    k0 = F.floor(F.try_divide(value - lo, width))
    cands = [k0 - 1, k0, k0 + 1]
    if closed_last:
        cands.append(F.lit(n - 1).cast("long"))
    arr = F.array_distinct(F.array(*[c.cast("long") for c in cands]))

    def member(k: Column) -> Column:
        kd = k.cast("double")
        upper = value < end(kd)
        if closed_last:
            upper = upper | ((k == F.lit(n - 1)) & (value <= end(kd)))
        return (k >= 0) & (k < n) & (value >= start(kd)) & upper

    return F.filter(arr, member)


def bin_of(value: Column, lo: Column, width: Column, n: int, start: BoundFn, end: BoundFn) -> Column:
    """The bin k in [0, n) with start(k) <= value < end(k), NULL if there is none, for bins of which
    each ends exactly where the next begins, so that no value is in two."""
    k0 = F.floor(F.try_divide(value - lo, width)).cast("long")

    def holds(k: Column) -> Column:
        kd = k.cast("double")
        return (k >= 0) & (k < n) & (value >= start(kd)) & (value < end(kd))

    return F.when(holds(k0), k0).when(holds(k0 - 1), k0 - 1).when(holds(k0 + 1), k0 + 1)


def bin_grid(spark, n: int, name: str = "bin_number") -> DataFrame:
    """n bins numbered 0..n-1 (a tiny relation used to keep empty bins)."""
    return spark.range(n).select(F.col("id").alias(name))
