"""Window operators.

Windows over the whole (time-ordered) table go through
:func:`ticklens.plans.ordered.ordered_window`, which spreads a global ROWS
frame over buckets; their rows come out in (timestamp, id) order.  Windows over a bounded top-N slice (the
reference's `ORDER BY ... DESC LIMIT 100` forms) take that slice first with
a TakeOrdered limit; only those few rows meet in one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import asc, pct_change as _pct
from ..functions.timeframe import timeframe_filter
from ..plans.ordered import INDEX_COL, materialize, ordered_window
from .filters import feed_rows, pair_filter

TRADE_ORDER = ["timestamp", "id"]
TICK_ORDER = ["time", "id"]
# Periods of the dashboard's moving averages.
AVERAGE_PERIODS = (10, 20, 50)


def _newest(df: DataFrame, n: int, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col("id").desc_nulls_last()).limit(n)


def price_changes(trades: DataFrame, timeframe=None, as_of=None, keep_first: bool = True,
                  **tuning) -> DataFrame:
    """prev_price = LAG(price) and pct_change in (timestamp, id) order.

    The first row has NULL prev_price; with ``keep_first=False`` it is dropped
    (the change series proper: every row but the first).
    """
    t = timeframe_filter(trades, timeframe, as_of)
    out = ordered_window(t, TRADE_ORDER, lambda w: {"prev_price": F.lag("price").over(w)},
                         halo=1, keep_index=True, **tuning)
    if not keep_first:
        out = out.filter(F.col(INDEX_COL) > 0)
    return out.drop(INDEX_COL).withColumn("pct_change", _pct("price", "prev_price"))


def rolling_volatility(trades: DataFrame, window: int = 20, timeframe=None, as_of=None,
                       **tuning) -> DataFrame:
    """STDDEV and AVG(ABS) of pct_change over the last `window` changes
    (ROWS window-1 PRECEDING); rows without a rolling value are dropped.

    The frame runs over the change rows (prev_price NOT NULL).  Without NULL
    prices the only row that is not a change is the first one, whose
    pct_change is NULL and ignored by STDDEV/AVG, so ONE ordered pass (LAG,
    then the frame, over the same blocks) gives the same frames.  With NULL
    prices the change series is written once and indexed again.
    """
    t = timeframe_filter(trades, timeframe, as_of)
    frame = lambda w: w.rowsBetween(-(window - 1), 0)

    def rolling(w):
        return {"rolling_volatility": F.stddev_samp("pct_change").over(frame(w)),
                "rolling_avg_change": F.avg(F.abs("pct_change")).over(frame(w))}

    # one job answers both: the row count (for the ordered core) and whether any price is NULL
    n, n_priced = t.agg(F.count(F.lit(1)), F.count("price")).first()
    if n_priced == n:
        stages = lambda w: [
            {"prev_price": F.lag("price").over(w)},
            {"pct_change": _pct("price", "prev_price")},
            rolling(w),
        ]
        # halo = window: the oldest halo row only feeds the next row's LAG
        out = ordered_window(t, TRADE_ORDER, stages, halo=window, n=n, **tuning) \
            .filter(F.col("prev_price").isNotNull())
    else:
        ch = materialize(price_changes(t, **tuning)
                         .filter(F.col("prev_price").isNotNull())
                         .select("timestamp", "id", "price", "pct_change"))
        out = ordered_window(ch, TRADE_ORDER, rolling, halo=window - 1, **tuning)
    return (out.filter(F.col("rolling_volatility").isNotNull())
            .select("timestamp", "id", "price", "pct_change", "rolling_volatility", "rolling_avg_change"))


def moving_averages(trades: DataFrame, periods: Sequence[int] = AVERAGE_PERIODS, timeframe=None,
                    as_of=None, **tuning) -> DataFrame:
    """ma_<p> = AVG(price) over the last p rows; partial windows at the start."""
    t = timeframe_filter(trades, timeframe, as_of)
    out = ordered_window(t, TRADE_ORDER, lambda w: {
        f"ma_{p}": F.avg("price").over(w.rowsBetween(-(p - 1), 0)) for p in periods
    }, halo=max(periods) - 1, **tuning)
    return out.select("timestamp", "id", "price", *[f"ma_{p}" for p in periods])


def ordered_analytics(trades: DataFrame, periods: Sequence[int] = AVERAGE_PERIODS, **tuning) -> DataFrame:
    """W1 and W3 in one ordered pass: all columns, in (timestamp, id) order, with prev_price, pct_change
    and ma_<p>."""
    out = ordered_window(trades, TRADE_ORDER, lambda w: {
        "prev_price": F.lag("price").over(w),
        **{f"ma_{p}": F.avg("price").over(w.rowsBetween(-(p - 1), 0)) for p in periods},
    }, halo=max(max(periods) - 1, 1), **tuning)
    return out.withColumn("pct_change", _pct("price", "prev_price"))


def moving_averages_periods(trades: DataFrame, periods: Sequence[int] = (5, 10, 20),
                            limit: int = 100, pair: str = "BTC-USD") -> DataFrame:
    """Any periods over one pair, the newest `limit` rows (newest first).

    Only the newest limit + max(period) - 1 rows can feed those frames, so
    they are taken first (top-N) and the frames run on that bounded slice.
    """
    t = pair_filter(trades, pair)
    slice_ = _newest(t, limit + max(periods) - 1)
    w = Window.orderBy(F.col("timestamp").asc_nulls_last(), F.col("id").asc_nulls_last())
    framed = slice_.select("timestamp", "id", "price", *[
        F.avg("price").over(w.rowsBetween(-(p - 1), 0)).alias(f"ma_{p}") for p in periods])
    return _newest(framed, limit)


def moving_averages_full(trades: DataFrame, periods: Sequence[int] = (7, 25, 99), timeframe=None,
                         as_of=None, **tuning) -> DataFrame:
    """ma<p> only where the window holds p rows; rows before the
    smallest period are omitted."""
    t = timeframe_filter(trades, timeframe, as_of)
    cols = {}
    for p in periods:
        frame = lambda w, p=p: w.rowsBetween(-(p - 1), 0)
        cols[p] = frame
    out = ordered_window(t, TRADE_ORDER, lambda w: {
        f"ma{p}": F.when(F.count(F.lit(1)).over(cols[p](w)) == p, F.avg("price").over(cols[p](w)))
        for p in periods
    }, halo=max(periods) - 1, keep_index=True, **tuning)
    return (out.filter(F.col(INDEX_COL) >= min(periods) - 1)
            .select("timestamp", "id", "price", *[f"ma{p}" for p in periods]))


def moving_averages_filled(trades: DataFrame, periods: Sequence[int] = AVERAGE_PERIODS, timeframe=None,
                           as_of=None, **tuning) -> DataFrame:
    """ma_<p> over p rows once the window is full, the price itself before."""
    t = timeframe_filter(trades, timeframe, as_of)
    out = ordered_window(t, TRADE_ORDER, lambda w: {
        f"ma_{p}": F.when(F.col(INDEX_COL) >= p - 1, F.avg("price").over(w.rowsBetween(-(p - 1), 0)))
                    .otherwise(F.col("price"))
        for p in periods
    }, halo=max(periods) - 1, **tuning)
    return out.select("timestamp", "id", "price", *[f"ma_{p}" for p in periods])


def source_analytics(ticks: DataFrame, **tuning) -> DataFrame:
    """Per source in time order: moving_avg_5 (frame 5 PRECEDING..CURRENT,
    six rows), prev_price, pct_change."""
    out = ordered_window(ticks, TICK_ORDER, lambda w: {
        "moving_avg_5": F.avg("price").over(w.rowsBetween(-5, 0)),
        "prev_price": F.lag("price").over(w),
    }, halo=5, partition_by=["source"], **tuning)
    return out.select("id", "price", "time", "source", "subject", "moving_avg_5", "prev_price",
                      _pct("price", "prev_price").alias("pct_change"))


def newest_source_analytics(ticks: DataFrame, selected: str = "nex", limit: int = 100) -> DataFrame:
    """F3 over W7: the newest `limit` rows of the selected feed with their per-source frames.

    A frame reaches five rows back in its source, so each source's newest limit + 5 rows are
    enough; Spark limits them before it shuffles."""
    own = feed_rows(ticks, selected)
    newest = Window.partitionBy("source").orderBy(F.col("time").desc_nulls_last(), F.col("id").desc_nulls_last())
    slice_ = own.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit + 5)
    w = Window.partitionBy("source").orderBy(F.col("time").asc_nulls_last(), F.col("id").asc_nulls_last())
    framed = slice_.select("id", "price", "time", "source", "subject", "_rn",
                           F.avg("price").over(w.rowsBetween(-5, 0)).alias("moving_avg_5"),
                           F.lag("price").over(w).alias("prev_price"))
    return (_newest(framed.filter(F.col("_rn") <= limit), limit, ts="time")
            .withColumn("pct_change", _pct("price", "prev_price")).drop("_rn"))


def tick_analytics(ticks: DataFrame, limit: int = 100) -> DataFrame:
    """moving_avg_5 and prev_price over all ticks (no partition), newest
    `limit` rows.  The six-row frame needs five older rows, so the newest
    limit + 5 rows are taken first."""
    slice_ = _newest(ticks, limit + 5, ts="time")
    w = Window.orderBy(F.col("time").asc_nulls_last(), F.col("id").asc_nulls_last())
    framed = slice_.select("id", "price", "time", "source", "subject",
                           F.avg("price").over(w.rowsBetween(-5, 0)).alias("moving_avg_5"),
                           F.lag("price").over(w).alias("prev_price"))
    return _newest(framed, limit, ts="time")


def trailing_price_volatility(trades: DataFrame, window: int = 10, timeframe=None, as_of=None,
                              **tuning) -> DataFrame:
    """Population stddev of the previous `window` prices (current row
    excluded) and its percentage of their mean; from row `window` on."""
    t = timeframe_filter(trades, timeframe, as_of)
    out = ordered_window(t, TRADE_ORDER, lambda w: {
        "volatility": F.stddev_pop("price").over(w.rowsBetween(-window, -1)),
        "_mean": F.avg("price").over(w.rowsBetween(-window, -1)),
    }, halo=window, keep_index=True, **tuning)
    return (out.filter(F.col(INDEX_COL) >= window)
            .select("timestamp", "id", "volatility",
                    (F.try_divide(F.col("volatility"), F.col("_mean")) * F.lit(100.0)).alias("percent_volatility")))


def price_rank(trades: DataFrame, **tuning) -> DataFrame:
    """ROW_NUMBER and LAG(price) in price order (ties by id)."""
    out = ordered_window(trades, ["price", "id"], lambda w: {"prev_price": F.lag("price").over(w)},
                         halo=1, keep_index=True, **tuning)
    return out.select("id", "price", (F.col(INDEX_COL) + 1).cast("long").alias("rank"), "prev_price")
