"""Session statistics (A1-A8, S13): single-pass partial aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import time_key
from ..functions.timeframe import timeframe_filter, validate_stats_timeframe
from ..plans.ordered import exact_quantiles
from .filters import pair_filter

def _first_price():
    return F.min_by(F.col("price"), time_key())


def _last_price():
    return F.max_by(F.col("price"), time_key())


def session_stats(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """A1: session_high, session_low, trade_count, avg_price."""
    t = timeframe_filter(trades, timeframe, as_of)
    return t.agg(F.max("price").alias("session_high"), F.min("price").alias("session_low"),
                 F.count(F.lit(1)).alias("trade_count"), F.avg("price").alias("avg_price"))


def first_price(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """A2: earliest price in the timeframe (order timestamp, id); no row if empty."""
    t = timeframe_filter(trades, timeframe, as_of).filter(F.col("timestamp").isNotNull())
    return t.agg(_first_price().alias("first_price"), F.count(F.lit(1)).alias("_n")) \
            .filter(F.col("_n") > 0).drop("_n")


def current_price(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """A3: latest price in the timeframe; no row if empty."""
    t = timeframe_filter(trades, timeframe, as_of).filter(F.col("timestamp").isNotNull())
    return t.agg(_last_price().alias("current_price"), F.count(F.lit(1)).alias("_n")) \
            .filter(F.col("_n") > 0).drop("_n")


def comprehensive_stats(trades: DataFrame, timeframe=60, as_of=None, validate: bool = True) -> DataFrame:
    """A4: A1 + first/current price + change_percent in ONE aggregate.

    Missing first/current prices become 0; change_percent is 0 when either
    price is 0 or missing.  The timeframe must be minutes in (0, 1440].
    """
    if validate:
        validate_stats_timeframe(timeframe)
    t = timeframe_filter(trades, timeframe, as_of)
    agg = t.agg(
        F.max("price").alias("session_high"), F.min("price").alias("session_low"),
        F.count(F.lit(1)).alias("trade_count"), F.avg("price").alias("avg_price"),
        _first_price().alias("_first"), _last_price().alias("_cur"))
    first = F.coalesce(F.col("_first"), F.lit(0.0))
    cur = F.coalesce(F.col("_cur"), F.lit(0.0))
    change = F.when((first != 0) & (cur != 0), (cur - first) / first * F.lit(100.0)).otherwise(F.lit(0.0))
    return agg.select("session_high", "session_low", "trade_count", "avg_price",
                      first.alias("first_price"), cur.alias("current_price"),
                      change.alias("change_percent"))


def pair_stats(trades: DataFrame, timeframe="5m", as_of=None, pair: str = "BTC-USD") -> DataFrame:
    """A5: one pair over a named timeframe ('all' = the whole table) or a number of minutes."""
    t = pair_filter(timeframe_filter(trades, timeframe, as_of), pair)
    agg = t.agg(
        F.max("price").alias("session_high"), F.min("price").alias("session_low"),
        _last_price().alias("current_price"), _first_price().alias("session_open"),
        F.count(F.lit(1)).alias("trade_count"), F.avg("price").alias("avg_price"),
        F.sum("size").alias("total_volume"))
    cur, opn = F.col("current_price"), F.col("session_open")
    change = F.when((cur != 0) & (opn != 0), (cur - opn) / opn * F.lit(100.0))
    return agg.withColumn("change_percent", change)


def table_summary(trades: DataFrame) -> DataFrame:
    """Whole table count, avg, min, max price."""
    return trades.agg(F.count(F.lit(1)).alias("trade_count"), F.avg("price").alias("avg_price"),
                      F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def side_summary(trades: DataFrame) -> DataFrame:
    """Per side count, avg price, total size; ordered by side."""
    return (trades.groupBy("side")
            .agg(F.count(F.lit(1)).alias("count"), F.avg("price").alias("avg_price"),
                 F.sum("size").alias("total_size"))
            .orderBy(F.col("side").asc_nulls_last()))


def price_dispersion(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """total_records, avg_price, price_stddev (sample) and exact
    median_price (PERCENTILE_CONT 0.5).

    The median is exact and found by bucket selection
    (:func:`ticklens.plans.ordered.exact_quantiles`): only the rows of the
    bucket holding the middle rank are ranked, nothing holds all prices.
    """
    t = timeframe_filter(trades, timeframe, as_of)
    # count / avg / stddev over all rows (NULL prices counted by count(*)); the median counts on from there
    found = t.agg(F.count(F.lit(1)).alias("total_records"), F.avg(F.col("price").cast("double")).alias("avg_price"),
                  F.stddev_samp("price").alias("price_stddev"), F.count("price").alias("_priced")).first()
    med, _ = exact_quantiles(t, "price", "id", {"median_price": 0.5}, n=found["_priced"])
    row = (found["total_records"], found["avg_price"], found["price_stddev"], med["median_price"])
    return t.sparkSession.createDataFrame([row], "total_records long, avg_price double, price_stddev double, median_price double")


def trade_count(trades: DataFrame) -> DataFrame:
    """Row count of the trades relation."""
    return trades.agg(F.count(F.lit(1)).alias("count"))


def table_exists(spark, name: str) -> bool:
    """Existence check of a registered table or view."""
    return spark.catalog.tableExists(name)
