"""Time bars (B1-B6): hash aggregates keyed by a truncated or floored time."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asc, epoch_micros_ntz, ntz_from_micros, time_key, trunc_ntz
from ..functions.timeframe import timeframe_filter
from .filters import pair_filter

# DATE_TRUNC units accepted by the aggregated price query, and the
# sub-minute bar widths (seconds) of the live chart.
PRICE_UNITS = ("second", "minute", "hour")
INTERVAL_BARS = {"1s": 1, "5s": 5, "10s": 10, "30s": 30}

def _check_unit(unit: str) -> None:
    if unit not in PRICE_UNITS:
        raise ValueError(f"{unit!r} is no bar unit; use one of {', '.join(PRICE_UNITS)}")


def aggregated_price(trades: DataFrame, unit: str = "second", timeframe=None, as_of=None) -> DataFrame:
    """B1: per DATE_TRUNC(unit): avg price, trade_count, low, high."""
    _check_unit(unit)
    t = timeframe_filter(trades, timeframe, as_of)
    return (t.groupBy(trunc_ntz(unit, "timestamp").alias("timestamp"))
            .agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("trade_count"),
                 F.min("price").alias("low"), F.max("price").alias("high"))
            .orderBy(*asc("timestamp")))


def ohlc_bars(trades: DataFrame, unit: str = "minute", timeframe=None, as_of=None) -> DataFrame:
    """B2: open/high/low/close per DATE_TRUNC(unit); `volume` is the trade COUNT.

    open/close come from min_by/max_by on (timestamp, id) — one partial
    aggregate instead of two ROW_NUMBER windows.
    """
    _check_unit(unit)
    t = timeframe_filter(trades, timeframe, as_of)
    return (t.groupBy(trunc_ntz(unit, "timestamp").alias("timestamp"))
            .agg(F.min_by("price", time_key()).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", time_key()).alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .orderBy(*asc("timestamp")))


def _floor_bucket(seconds: int) -> Column:
    width = seconds * 1_000_000
    return ntz_from_micros(F.floor(epoch_micros_ntz("timestamp") / F.lit(width)) * F.lit(width))


def ohlcv_interval_bars(trades: DataFrame, interval="5s", timeframe=None, as_of=None) -> DataFrame:
    """Epoch-aligned bars of 1/5/10/30 s (or any whole number of seconds):
    avg price, open, high, low, close, summed volume; ascending."""
    seconds = INTERVAL_BARS.get(interval, interval) if isinstance(interval, str) else interval
    if not isinstance(seconds, int) or seconds <= 0:
        raise ValueError(f"invalid bar interval: {interval!r}")
    t = timeframe_filter(trades, timeframe, as_of)
    return (t.groupBy(_floor_bucket(seconds).alias("timestamp"))
            .agg(F.avg("price").alias("price"), F.min_by("price", time_key()).alias("open"),
                 F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", time_key()).alias("close"), F.sum("size").alias("volume"))
            .orderBy(*asc("timestamp")))


def price_history(trades: DataFrame, minutes: int = 100, limit: int = 100, as_of=None,
                  pair: str = "BTC-USD") -> DataFrame:
    """One pair, the last `minutes` minutes, minute bars; the newest
    `limit` buckets (descending), close exposed as `price`."""
    t = pair_filter(timeframe_filter(trades, minutes, as_of), pair)
    bars = (t.groupBy(trunc_ntz("minute", "timestamp").alias("time_bucket"))
            .agg(F.min_by("price", time_key()).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", time_key()).alias("close"),
                 F.avg("price").alias("avg_price"), F.sum("size").alias("volume"),
                 F.count(F.lit(1)).alias("trade_count")))
    top = bars.orderBy(F.col("time_bucket").desc_nulls_last()).limit(limit)
    return top.select(F.col("time_bucket").alias("timestamp"), F.col("close").alias("price"),
                      "open", "high", "low", "volume", "trade_count") \
              .orderBy(F.col("timestamp").desc_nulls_last())


def volume_over_time(trades: DataFrame, unit: str = "minute", timeframe=None, as_of=None) -> DataFrame:
    """Per DATE_TRUNC(unit): total, buy and sell volume, trade count."""
    t = timeframe_filter(trades, timeframe, as_of)
    size = F.col("size")
    return (t.groupBy(trunc_ntz(unit, "timestamp").alias("time_bucket"))
            .agg(F.sum(size).alias("total_volume"),
                 F.sum(F.when(F.col("side") == "buy", size).otherwise(F.lit(0.0))).alias("buy_volume"),
                 F.sum(F.when(F.col("side") == "sell", size).otherwise(F.lit(0.0))).alias("sell_volume"),
                 F.count(F.lit(1)).alias("trade_count"))
            .orderBy(*asc("time_bucket")))


def volume_5min(trades: DataFrame, timeframe=None, as_of=None, minutes: int = 5) -> DataFrame:
    """Volume per epoch-aligned 5-minute bucket; a zero or missing size counts as 1."""
    t = timeframe_filter(trades, timeframe, as_of)
    size = F.col("size")
    vol = F.when(size.isNull() | (size == 0) | F.isnan(size), F.lit(1.0)).otherwise(size)
    return (t.groupBy(_floor_bucket(minutes * 60).alias("timestamp"))
            .agg(F.sum(vol).alias("volume"))
            .orderBy(*asc("timestamp")))
