"""Readers for the parquet tables and the derived `trades` / `ticks` relations.

`trades` and `ticks` are plain projections of the `events` table (see
FIXTURES.md §3): no row is dropped, duplicated or reordered, so every
operator runs on the whole table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _trade_side(event_type: Column) -> Column:
    return (F.when(event_type.isin("purchase", "signup"), F.lit("buy"))
             .when(event_type.isin("click", "error"), F.lit("sell"))
             .otherwise(F.lit("unknown")))


def _trade_exchange(user_id: Column) -> Column:
    return (F.when(user_id % 3 == 0, F.lit("coinbase"))
             .when(user_id % 3 == 1, F.lit("binance"))
             .otherwise(F.lit("kraken")))


def trades_from_events(events: DataFrame) -> DataFrame:
    """Project `events` onto the canonical trades schema (FIXTURES.md §3)."""
    k = F.get_json_object(F.col("props"), "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("price"),
        ((k + F.lit(1.0)) / F.lit(100.0)).alias("size"),
        _trade_side(F.col("event_type")).alias("side"),
        _trade_exchange(F.col("user_id")).alias("exchange"),
        F.lit("BTC-USD").alias("pair"),
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Project `events` onto the tick log (price, time, source, subject)."""
    even = F.col("user_id") % 2 == 0
    return events.select(
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        F.col("ts").alias("time"),
        F.when(even, F.lit("NEX Stream")).otherwise(F.lit("Coinbase")).alias("source"),
        F.when(even, F.lit("market.btc-usd.trades")).otherwise(F.lit("ticker")).alias("subject"),
    )


def load_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(read_table(spark, sf_dir, "events"))


def load_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(read_table(spark, sf_dir, "events"))
