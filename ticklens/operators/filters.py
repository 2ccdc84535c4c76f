"""Filters and projections."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asc, notional
from ..functions.timeframe import timeframe_filter  # F1, re-exported

__all__ = ["timeframe_filter", "pair_filter", "source_filter", "price_series",
           "volume_series", "with_notional"]

# Source selector of the tick view -> LIKE prefix.
SOURCE_PREFIXES = {"nex": "NEX%", "coinbase": "Coinbase%"}


def pair_filter(df: DataFrame, pair: str = "BTC-USD") -> DataFrame:
    """one trading pair."""
    return df.filter(F.col("pair") == F.lit(pair))


def feed_rows(ticks: DataFrame, selected: str) -> DataFrame:
    """Rows whose source has the selected feed's prefix; 'both' keeps all."""
    pattern = SOURCE_PREFIXES.get(selected)
    return ticks if pattern is None else ticks.filter(F.col("source").like(pattern))


def source_filter(ticks: DataFrame, selected: str = "both", limit: int | None = 100,
                  exact: str | None = None) -> DataFrame:
    """rows of one feed of the tick view.

    ``selected`` in {'nex', 'coinbase', 'both'} keeps sources by prefix and
    returns the newest ``limit`` rows (top-k, not a cap on the input).
    ``exact`` keeps one source by equality, in ascending time order.
    """
    if exact is not None:
        return ticks.filter(F.col("source") == F.lit(exact)).orderBy(*asc("time", "id"))
    out = feed_rows(ticks, selected).orderBy(F.col("time").desc_nulls_last(), F.col("id").desc_nulls_last())
    return out.limit(limit) if limit is not None else out


def price_series(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """raw (timestamp, price) in the timeframe, ascending."""
    t = timeframe_filter(trades, timeframe, as_of)
    return t.select("timestamp", "price", "id").orderBy(*asc("timestamp", "id")).drop("id")


def volume_series(trades: DataFrame, timeframe=None, as_of=None, newest: int | None = None) -> DataFrame:
    """per-trade (timestamp, volume = size, price), ascending; or the newest N.

    A missing size stays NULL (the reference invents a random one).
    """
    t = timeframe_filter(trades, timeframe, as_of).select(
        "id", "timestamp", F.col("size").alias("volume"), "price")
    if newest is not None:
        t = t.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()).limit(newest)
    return t.orderBy(*asc("timestamp", "id")).drop("id")


def with_notional(trades: DataFrame) -> DataFrame:
    """add notional_value = price * size."""
    return trades.withColumn("notional_value", notional())
