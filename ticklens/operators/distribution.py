"""Price / volume distributions and the time x price heatmap.

Bin edges come from one-row min/max aggregates used as scalar subqueries (no
join with the trades); rows go to bins by arithmetic (``functions.bins``) and
a hash aggregate on the bin number, and a ``range(n)`` relation keeps empty
bins.  Only n (or n x m) groups ever reach the final aggregate.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_grid, bin_of, matching_bins
from ..functions.exprs import asc, epoch_micros_ntz, ntz_from_micros
from ..functions.timeframe import timeframe_filter
from ..plans.ordered import materialize
from .windows import price_changes


def _scalars(df: DataFrame, **aggs: Column) -> tuple[Column, ...]:
    """One-row aggregate as ONE scalar subquery (a struct); its fields are
    returned as columns.  Spark runs the subquery once and reuses it."""
    row = df.agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("s")).scalar()
    return tuple(row.getField(k) for k in aggs)


def _range_scalars(df: DataFrame, col: str = "price") -> tuple[Column, Column]:
    return _scalars(df, lo=F.min(col), hi=F.max(col))


def volume_distribution(trades: DataFrame, bins: int = 10, timeframe=None, as_of=None) -> DataFrame:
    """N equal price bins over the timeframe's [min, max]: bin_start,
    bin_end, volume (SUM(size), 0 when empty) and trade_count.  Bins are
    half-open, so the maximum price falls in none (as in the reference)."""
    t = timeframe_filter(trades, timeframe, as_of)
    lo, hi = _range_scalars(t)
    n = bins

    def start(k: Column) -> Column:
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (k / F.lit(float(n)))

    def end(k: Column) -> Column:
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * ((k + 1) / F.lit(float(n)))

    rows = t.select(F.col("price").alias("_v"), F.col("size"), lo.alias("_lo"), hi.alias("_hi"))
    k = bin_of(F.col("_v"), F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.lit(float(n)), n, start, end)
    per_bin = (rows.select(k.alias("bin_number"), "_v", "size").filter(F.col("bin_number").isNotNull())
               .groupBy("bin_number")
               .agg(F.sum("size").alias("_vol"), F.count("_v").alias("_cnt")))
    grid = bin_grid(trades.sparkSession, n).select("bin_number", lo.alias("_lo"), hi.alias("_hi"))
    out = grid.join(per_bin, "bin_number", "left")
    k = F.col("bin_number").cast("double")
    return (out.select(start(k).alias("bin_start"), end(k).alias("bin_end"),
                       F.coalesce(F.col("_vol"), F.lit(0.0)).alias("volume"),
                       F.coalesce(F.col("_cnt"), F.lit(0)).cast("long").alias("trade_count"),
                       "bin_number")
            .orderBy(*asc("bin_number")).drop("bin_number"))


def _width_bins(trades: DataFrame, bins: int, timeframe, as_of, closed_last: bool,
                end_from_start: bool) -> DataFrame:
    t = timeframe_filter(trades, timeframe, as_of)
    lo, hi = _range_scalars(t)
    n = bins
    width = (hi - lo) / F.lit(float(n))

    def start(k: Column) -> Column:
        return F.col("_lo") + F.col("_w") * k

    def end(k: Column) -> Column:
        return start(k) + F.col("_w") if end_from_start else F.col("_lo") + F.col("_w") * (k + 1)

    rows = t.select(F.col("price").alias("_v"), lo.alias("_lo"), width.alias("_w"))
    if end_from_start:  # by rounding, a bin may end a little off the next one's start: a value may be in two, or in none
        found = rows.select(F.explode(matching_bins(F.col("_v"), F.col("_lo"), F.col("_w"), n, start, end, closed_last)).alias("bin_number"))
    else:
        found = rows.select(bin_of(F.col("_v"), F.col("_lo"), F.col("_w"), n, start, end).alias("bin_number")).filter(F.col("bin_number").isNotNull())
    per_bin = found.groupBy("bin_number").agg(F.count(F.lit(1)).alias("_cnt"))
    grid = bin_grid(trades.sparkSession, n).select("bin_number", lo.alias("_lo"), width.alias("_w"))
    out = grid.join(per_bin, "bin_number", "left")
    k = F.col("bin_number").cast("double")
    return out.select(start(k).alias("bin_start"), end(k).alias("bin_end"),
                      F.col("bin_number").cast("long").alias("bin_number"),
                      F.coalesce(F.col("_cnt"), F.lit(0)).cast("long").alias("count"))


def price_distribution(trades: DataFrame, bins: int = 10, timeframe=None, as_of=None) -> DataFrame:
    """Count of prices per half-open bin, start = min + w*k, end = min +
    w*(k+1) with w = (max-min)/n.  Always n bins (the reference takes its bin
    list from `LIMIT n` rows of the table, so a shorter table had fewer)."""
    return (_width_bins(trades, bins, timeframe, as_of, closed_last=False, end_from_start=False)
            .orderBy(*asc("bin_number")).drop("bin_number"))


def price_distribution_closed(trades: DataFrame, bins: int = 10, timeframe=None, as_of=None) -> DataFrame:
    """As D5 but end = start + w and the last bin is closed on the right,
    so the maximum price is counted; adds bin_number."""
    return (_width_bins(trades, bins, timeframe, as_of, closed_last=True, end_from_start=True)
            .orderBy(*asc("bin_number")))


def price_histogram(trades: DataFrame, bins: int = 10, timeframe=None, as_of=None) -> DataFrame:
    """Clamped bins k = min(floor((p-min)/w), n-1): bin_start, bin_end,
    bin_center, count, percentage of all rows.  No rows when the input is empty."""
    t = timeframe_filter(trades, timeframe, as_of)
    lo, hi, total = _scalars(t, lo=F.min("price"), hi=F.max("price"), n=F.count(F.lit(1)))
    n = bins
    width = (hi - lo) / F.lit(float(n))
    raw_k = F.floor(F.try_divide(F.col("price") - lo, width))
    # least() skips NULLs: keep "no bin" (zero range, NULL price) as NULL
    k = F.when(raw_k.isNotNull(), F.least(raw_k, F.lit(n - 1)))
    per_bin = (t.select(k.alias("bin_number")).filter(F.col("bin_number").isNotNull())
               .groupBy("bin_number").agg(F.count(F.lit(1)).alias("_cnt")))
    grid = (bin_grid(trades.sparkSession, n)
            .select("bin_number", lo.alias("_lo"), width.alias("_w"), total.alias("_n"))
            .filter(F.col("_n") > 0))
    kd = F.col("bin_number").cast("double")
    cnt = F.coalesce(F.col("_cnt"), F.lit(0)).cast("long")
    return (grid.join(per_bin, "bin_number", "left")
            .select((F.col("_lo") + kd * F.col("_w")).alias("bin_start"),
                    (F.col("_lo") + (kd + 1) * F.col("_w")).alias("bin_end"),
                    (F.col("_lo") + (kd + 0.5) * F.col("_w")).alias("bin_center"),
                    cnt.alias("count"),
                    (cnt / F.col("_n") * F.lit(100.0)).alias("percentage"),
                    "bin_number")
            .orderBy(*asc("bin_number")).drop("bin_number"))


def rounded_step(lo: Column, hi: Column, n: int) -> tuple[Column, Column]:
    """The step between edges of about ``n`` bins over [lo, hi] at multiples of 1, 2 or 5 times a power
    of ten, as charts draw them: (size, fine), where a fine size is steps per unit and not units per
    step, a whole number, so that edges are exact decimals.  NULLs without a range.

    The step is the one of 1, 2, 5, 10 times a power of ten that is nearest, in ratio, to an nth of the
    range.
    """
    raw = (hi - lo) / F.lit(float(n))
    power = F.floor(F.log10(F.when(raw > 0, raw)))
    ratio = raw / F.pow(F.lit(10.0), power)
    factor = F.lit(1.0)
    for step, least in ((2.0, 2), (5.0, 10), (10.0, 50)):
        factor = F.when(ratio >= math.sqrt(least), F.lit(step)).otherwise(factor)
    return F.pow(F.lit(10.0), F.abs(power)) * F.when(power < 0, 1.0 / factor).otherwise(factor), power < 0


def rounded_edge(k: Column, size: Column, fine: Column) -> Column:
    """Where bin k begins."""
    return F.when(fine, k / size).otherwise(k * size)


def rounded_bin(v: Column, size: Column, fine: Column) -> Column:
    """The bin that holds a value, by its edges; 0 without a step."""
    k = F.floor(F.when(fine, v * size).otherwise(v / size))
    return F.coalesce(F.when(v >= rounded_edge(k + 1, size, fine), k + 1).when(v < rounded_edge(k, size, fine), k - 1).otherwise(k),
                      F.lit(0)).cast("long")


def histogram_by_source(ticks: DataFrame, bins: int = 20) -> DataFrame:
    """Price histogram with about `bins` rounded thresholds (see :func:`rounded_step`), counted per
    source: source, bin_number (from the lowest price's bin), bin_start, bin_end and count of non-empty
    cells.  Bins are half-open and the last one goes beyond the highest price; prices that are all
    equal have one bin, from and to themselves.  Missing and non-finite prices take no part."""
    t = ticks.filter(F.abs("price") < float("inf"))
    ends = t.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    size, fine = rounded_step(F.col("lo"), F.col("hi"), bins)
    step = ends.select("lo", size.alias("size"), fine.alias("fine")).select("*", rounded_bin(F.col("lo"), F.col("size"), F.col("fine")).alias("first"))
    one = step.select(F.struct("*").alias("s")).scalar()
    lo, size, fine, first = (one.getField(c) for c in ("lo", "size", "fine", "first"))
    counted = (t.select("source", rounded_bin(F.col("price"), size, fine).alias("_k"))
               .groupBy("source", "_k").agg(F.count(F.lit(1)).alias("count")))
    edge = lambda k: F.coalesce(rounded_edge(k, size, fine), lo)
    return (counted.select("source", (F.col("_k") - first).alias("bin_number"), edge(F.col("_k")).alias("bin_start"),
                           edge(F.col("_k") + 1).alias("bin_end"), "count")
            .orderBy(*asc("source", "bin_number")))


def price_time_heatmap(trades: DataFrame, time_bins: int = 10, price_bins: int = 10,
                       timeframe=None, as_of=None) -> DataFrame:
    """Counts of price-change rows in a time x price grid (empty cells 0).

    Change rows are all rows but the first in (timestamp, id) order.  The time
    range runs from the first change row to the last row; the price range
    covers all rows.  Cells are half-open in both directions, so the last
    time and the maximum price fall in no cell (as in the reference).
    Times are computed in epoch microseconds.
    """
    t = timeframe_filter(trades, timeframe, as_of).filter(F.col("timestamp").isNotNull())
    # one pass for the ranges and a top-2 for the first two rows: the change rows begin with the second
    us = epoch_micros_ntz("timestamp").cast("double")
    plo, phi, thi = _scalars(t, lo=F.min("price"), hi=F.max("price"), last=F.max(us))
    head = t.select("timestamp", "id").orderBy(*asc("timestamp", "id")).limit(2)
    first_key, n_head, tlo = _scalars(head, k=F.min(F.struct("timestamp", "id")), n=F.count(F.lit(1)), second=F.max(us))
    changes = t.filter(F.struct("timestamp", "id") > first_key)
    tlo = F.when(n_head == 2, tlo)  # of one row there is no change
    tw = (thi - tlo) / F.lit(float(time_bins))
    pw = (phi - plo) / F.lit(float(price_bins))

    def tstart(k):
        return F.col("_tlo") + k * F.col("_tw")

    def tend(k):
        return F.col("_tlo") + (k + 1) * F.col("_tw")

    def pstart(k):
        return F.col("_plo") + k * F.col("_pw")

    def pend(k):
        return F.col("_plo") + (k + 1) * F.col("_pw")

    rows = changes.select(us.alias("_t"), F.col("price").alias("_p"),
                          tlo.alias("_tlo"), tw.alias("_tw"), plo.alias("_plo"), pw.alias("_pw"))
    cells = (rows.select(bin_of(F.col("_t"), F.col("_tlo"), F.col("_tw"), time_bins, tstart, tend).alias("time_bin"),
                         bin_of(F.col("_p"), F.col("_plo"), F.col("_pw"), price_bins, pstart, pend).alias("price_bin"))
             .filter(F.col("time_bin").isNotNull() & F.col("price_bin").isNotNull())
             .groupBy("time_bin", "price_bin").agg(F.count(F.lit(1)).alias("_cnt")))
    spark = trades.sparkSession
    grid = spark.range(time_bins * price_bins).select(
        (F.col("id") / price_bins).cast("long").alias("time_bin"),
        (F.col("id") % price_bins).alias("price_bin"),
        tlo.alias("_tlo"), tw.alias("_tw"), plo.alias("_plo"), pw.alias("_pw"))
    g = grid.join(cells, ["time_bin", "price_bin"], "left")
    ti, pj = F.col("time_bin").cast("double"), F.col("price_bin").cast("double")
    ts0, ts1 = tstart(ti), tend(ti)
    ps0, ps1 = pstart(pj), pend(pj)
    return (g.select("time_bin", "price_bin",
                     ntz_from_micros(F.floor(ts0)).alias("time_start"),
                     ntz_from_micros(F.floor(ts1)).alias("time_end"),
                     ps0.alias("price_start"), ps1.alias("price_end"),
                     F.coalesce(F.col("_cnt"), F.lit(0)).cast("long").alias("count"),
                     ntz_from_micros(F.floor((ts0 + ts1) / 2)).alias("mid_time"),
                     ((ps0 + ps1) / 2).alias("mid_price"))
            .orderBy(*asc("time_bin", "price_bin")))


def change_intensity(trades: DataFrame, timeframe=None, as_of=None, min_rows: int = 0) -> DataFrame:
    """Per change row: pct_change, intensity = min(1, |chg| / max|chg|) and
    direction ('negative' / 'positive'); with `min_rows`, empty unless there
    are more rows than that."""
    t = timeframe_filter(trades, timeframe, as_of)
    # one count serves the ordered core and the "more than min_rows" guard;
    # the change series feeds both max|chg| and the rows, so it is written once
    n = t.count()
    if n <= min_rows:
        return t.select("timestamp", "id", F.lit(None).cast("double").alias("pct_change"),
                        F.lit(None).cast("double").alias("intensity"),
                        F.lit(None).cast("string").alias("direction")).filter(F.lit(False))
    ch = materialize(price_changes(t, keep_first=False, n=n).select("timestamp", "id", "pct_change"))
    max_abs = ch.agg(F.max(F.abs("pct_change"))).scalar()
    return (ch.select("timestamp", "id", "pct_change",
                    F.least(F.lit(1.0), F.try_divide(F.abs("pct_change"), max_abs)).alias("intensity"),
                    F.when(F.col("pct_change") < 0, F.lit("negative")).otherwise(F.lit("positive"))
                    .alias("direction"))
            .orderBy(*asc("timestamp", "id")))
