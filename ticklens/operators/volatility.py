"""Volatility and risk (V1-V7) over the price-change series."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import extract_bigint, frac_change, pct_change, volatility_level
from ..functions.timeframe import timeframe_filter
from ..plans.ordered import INDEX_COL, exact_quantiles, materialize, ordered_window
from .filters import pair_filter
from .windows import TRADE_ORDER, price_changes

# Order of the clustering levels in the output.
LEVEL_ORDER = {"low": 1, "medium": 2, "high": 3}
EXTRACT_UNITS = ("year", "month", "day", "hour", "minute", "second", "dayofweek", "doy", "week", "quarter")


def _changes(trades, timeframe, as_of, **tuning) -> DataFrame:
    return price_changes(trades, timeframe, as_of, **tuning).filter(F.col("prev_price").isNotNull())


def basic_volatility(trades: DataFrame, timeframe=None, as_of=None, **tuning) -> DataFrame:
    """V1: STDDEV, AVG(ABS), MIN, MAX and COUNT of the pct changes."""
    return volatility_of(_changes(trades, timeframe, as_of, **tuning))


def volatility_of(changes: DataFrame) -> DataFrame:
    """V1 of a change series (rows with a pct_change)."""
    return changes.agg(F.stddev_samp("pct_change").alias("volatility"),
                       F.avg(F.abs("pct_change")).alias("avg_change"),
                       F.min("pct_change").alias("min_change"), F.max("pct_change").alias("max_change"),
                       F.count(F.lit(1)).alias("sample_size"))


def volatility_by_period(trades: DataFrame, unit: str = "hour", timeframe=None, as_of=None,
                         **tuning) -> DataFrame:
    """V2: V1 grouped by EXTRACT(unit FROM timestamp) (BIGINT)."""
    if unit not in EXTRACT_UNITS:
        raise ValueError(f"invalid time unit: {unit}")
    ch = _changes(trades, timeframe, as_of, **tuning)
    return (ch.groupBy(extract_bigint(unit, "timestamp").alias("time_period"))
            .agg(F.stddev_samp("pct_change").alias("volatility"),
                 F.avg(F.abs("pct_change")).alias("avg_change"),
                 F.count(F.lit(1)).alias("trade_count"),
                 F.min("pct_change").alias("min_change"), F.max("pct_change").alias("max_change"))
            .orderBy(F.col("time_period").asc_nulls_last()))


def volatility_clustering(trades: DataFrame, timeframe=None, as_of=None, **tuning) -> DataFrame:
    """V3: level high (>1 %) / medium (>0.5 %) / low -> count and avg/min/max
    abs change; ordered low, medium, high."""
    ch = _changes(trades, timeframe, as_of, **tuning).withColumn("abs_pct_change", F.abs("pct_change"))
    rank = F.lit(LEVEL_ORDER["low"])
    for level in ("medium", "high"):
        rank = F.when(F.col("volatility_level") == level, F.lit(LEVEL_ORDER[level])).otherwise(rank)
    return (ch.groupBy(volatility_level("abs_pct_change").alias("volatility_level"))
            .agg(F.count(F.lit(1)).alias("occurrence_count"),
                 F.avg("abs_pct_change").alias("avg_volatility"),
                 F.min("abs_pct_change").alias("min_volatility"),
                 F.max("abs_pct_change").alias("max_volatility"))
            .orderBy(rank))


def value_at_risk(trades: DataFrame, confidence: float = 0.95, timeframe=None, as_of=None,
                  approx: bool = False, accuracy: int = 10_000, **tuning) -> DataFrame:
    """V4: PERCENTILE_CONT(1 - confidence) of pct_change as var_<conf%>, with
    STDDEV, AVG and COUNT over non-NULL changes.

    The change series is written once (it feeds two passes); the percentile
    is exact, by bucket selection: bucket counts, then only the rows of the
    bucket(s) holding the interpolation ranks are ranked.  `approx=True`
    uses `percentile_approx` (one pass, rank error about 1/accuracy) instead.
    """
    name = f"var_{round(confidence * 100)}"
    q = (1 - confidence) * 100 / 100
    if approx:
        ch = (price_changes(trades, timeframe, as_of, **tuning).filter(F.col("pct_change").isNotNull()))
        return ch.agg(F.percentile_approx("pct_change", q, accuracy).alias(name),
                      F.stddev_samp("pct_change").alias("volatility"),
                      F.avg("pct_change").alias("mean_return"), F.count(F.lit(1)).alias("sample_size"))
    ch = materialize(price_changes(trades, timeframe, as_of, **tuning)
                     .filter(F.col("pct_change").isNotNull()).select("pct_change", "id"))
    found = ch.agg(F.stddev_samp("pct_change").alias("sd"), F.avg("pct_change").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    var, _ = exact_quantiles(ch, "pct_change", "id", {name: q}, n=found["n"])
    return trades.sparkSession.createDataFrame([(var[name], found["sd"], found["mean"], found["n"])],
                                               f"{name} double, volatility double, mean_return double, sample_size long")


def recent_volatility(trades: DataFrame, limit: int = 1000, pair: str = "BTC-USD") -> DataFrame:
    """V5: over the newest `limit` trades of one pair: STDDEV, avg |change|,
    max gain, max loss, count.  LAG sees the row before the slice, so the
    newest limit + 1 rows are taken (top-N) before the frame."""
    t = pair_filter(trades, pair)
    newest = t.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(limit + 1)
    w = Window.orderBy(F.col("timestamp").asc_nulls_last(), F.col("id").asc_nulls_last())
    ch = newest.select("timestamp", "id", "price", F.lag("price").over(w).alias("prev"))
    top = (ch.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(limit)
           .withColumn("pct_change", pct_change("price", "prev"))
           .filter(F.col("pct_change").isNotNull()))
    return top.agg(F.stddev_samp("pct_change").alias("volatility"),
                   F.avg(F.abs("pct_change")).alias("avg_abs_change"),
                   F.max("pct_change").alias("max_gain"), F.min("pct_change").alias("max_loss"),
                   F.count(F.lit(1)).alias("sample_size"))


def _returns(trades: DataFrame, timeframe, as_of, positive_only: bool, **tuning) -> DataFrame:
    t = timeframe_filter(trades, timeframe, as_of)
    if positive_only:
        t = t.filter(F.col("price") > 0)
    out = ordered_window(t, TRADE_ORDER, lambda w: {"_prev": F.lag("price").over(w)},
                         halo=1, keep_index=True, **tuning)
    return out.filter(F.col(INDEX_COL) > 0).withColumn("ret", frac_change("price", "_prev"))


def population_volatility(trades: DataFrame, timeframe=None, as_of=None, **tuning) -> DataFrame:
    """V6: STDDEV_POP of fractional returns x 100; no row with fewer than 2 trades."""
    r = _returns(trades, timeframe, as_of, positive_only=False, **tuning)
    return (r.agg((F.stddev_pop("ret") * F.lit(100.0)).alias("volatility"), F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= 1).drop("_n"))


def rms_volatility(trades: DataFrame, timeframe=None, as_of=None, **tuning) -> DataFrame:
    """V7: sqrt(mean(ret^2)) x 100 over trades with price > 0; no row with
    fewer than 2 such trades."""
    r = _returns(trades, timeframe, as_of, positive_only=True, **tuning)
    return (r.agg((F.sqrt(F.avg(F.col("ret") * F.col("ret"))) * F.lit(100.0)).alias("volatility"),
                  F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= 1).drop("_n"))
