"""Stored OHLCV rollups that later batches of trades merge into.

A bar is kept as what can be merged: open and close with the keys that order them, extremes, sums and
counts.  A batch becomes such partial bars, those of the same (timeframe, date) folders are read, both
are aggregated once more, and only those folders are replaced; what they hold of other bars is read
and written, every other folder stays as it is.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import epoch_micros_ntz, ntz_from_micros, time_key
from .snapshots import SnapshotTable, _key

# Rollup timeframes (name -> seconds).
ROLLUP_TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600}
KEYS = ("timeframe", "date")
#: What a reader of bars sees.
BAR_COLUMNS = ("timestamp", "timeframe", "open_price", "high_price", "low_price", "close_price", "volume", "trade_count")
_D, _L, _K = T.DoubleType(), T.LongType(), T.DecimalType(38, 0)
PARTIAL = T.StructType([T.StructField(n, t) for n, t in (
    ("timestamp", T.TimestampNTZType()), ("open_price", _D), ("open_key", _K), ("high_price", _D), ("low_price", _D), ("close_price", _D),
    ("close_key", _K), ("volume", _D), ("trade_count", _L), ("timeframe", T.StringType()), ("date", T.DateType()))])


def merged_bars(bars: DataFrame, *by) -> DataFrame:
    """Partial bars of one key as one: the first open, the last close, extremes, sums."""
    return bars.groupBy(*by).agg(
        F.min_by("open_price", "open_key").alias("open_price"), F.min("open_key").alias("open_key"),
        F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"),
        F.max_by("close_price", "close_key").alias("close_price"), F.max("close_key").alias("close_key"),
        F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"))


def partial_bars(trades: DataFrame, timeframes: Sequence[str] = tuple(ROLLUP_TIMEFRAMES)) -> DataFrame:
    """Mergeable bars per (timestamp, timeframe), epoch-aligned, with their date.

    Trades are aggregated to minutes once; the longer timeframes, all whole minutes, are aggregates of
    those bars, so the fan-out is of bars and not of trades.
    """
    unknown = [t for t in timeframes if t not in ROLLUP_TIMEFRAMES]
    if unknown:
        raise ValueError(f"{unknown[0]!r} is no rollup timeframe; use {', '.join(ROLLUP_TIMEFRAMES)}")
    width, key = 60_000_000, time_key()
    minute = (F.floor(epoch_micros_ntz("timestamp") / F.lit(width)) * F.lit(width)).alias("m")
    one = trades.select(minute, F.col("price").alias("open_price"), key.alias("open_key"), F.col("price").alias("high_price"),
                        F.col("price").alias("low_price"), F.col("price").alias("close_price"), key.alias("close_key"),
                        F.col("size").alias("volume"), F.lit(1).cast("long").alias("trade_count"))
    minutes = merged_bars(one, "m")
    widths = F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(ROLLUP_TIMEFRAMES[t] * 1_000_000).alias("w")) for t in timeframes])
    bucket = ntz_from_micros(F.floor(F.col("m") / F.col("r.w")) * F.col("r.w"))
    bars = minutes.select("*", F.explode(widths).alias("r")).withColumn("timestamp", bucket).withColumn("timeframe", F.col("r.tf"))
    return merged_bars(bars, "timestamp", "timeframe").withColumn("date", F.to_date("timestamp")).select(*PARTIAL.names)


def rollups(trades: DataFrame, timeframes: Sequence[str] = tuple(ROLLUP_TIMEFRAMES)) -> DataFrame:
    """S11 rows: OHLCV + trade_count per (timestamp, timeframe), unique by construction."""
    return partial_bars(trades, timeframes).select(*BAR_COLUMNS)


def rollup_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, PARTIAL, KEYS)


def write_rollups(trades: DataFrame, path: str, timeframes: Sequence[str] = tuple(ROLLUP_TIMEFRAMES),
                  writer: str | None = None, batch: int | None = None) -> int:
    """Merge a batch of trades into the rollups stored below ``path``; returns the table's version.

    Bars that the batch doesn't reach stay as they are.  With ``writer`` and ``batch`` (ascending) a
    batch that is in the table already is skipped, so it may be sent again after a failure.  Bars
    without a time (of trades without one) are merged like any other.
    """
    spark = trades.sparkSession
    table = rollup_table(spark, path)
    base = table.manifest()
    if table.has(writer, batch, base):
        return base.version
    new = partial_bars(trades, timeframes).persist()  # small: bars; feeds the list of folders and the merge
    try:
        touched = {_key(r, KEYS) for r in new.select(*KEYS).distinct().collect()}
        old = table.read(base, touched.__contains__)
        merged = merged_bars(old.unionByName(new), "timestamp", *KEYS)
        return table.write(merged.repartition(*KEYS).sortWithinPartitions(*KEYS, "timestamp"), base=base, replace=True,
                           keys=touched, writer=writer, batch=batch).version
    finally:
        new.unpersist()


def read_rollups(spark: SparkSession, path: str) -> DataFrame:
    """The stored bars, newest version; a filter on ``timeframe`` or ``date`` reads those folders only."""
    return rollup_table(spark, path).read().select(*BAR_COLUMNS, "date")


def write_rollups_stream(trades_stream: DataFrame, path: str, checkpoint: str, timeframes: Sequence[str] = tuple(ROLLUP_TIMEFRAMES),
                         trigger: dict | None = None):
    """S11 on a stream: each micro-batch is merged; one that is run again after a failure is skipped,
    as its number is in the table's manifest under the checkpoint's name."""
    def merge(batch: DataFrame, epoch: int) -> None:
        write_rollups(batch, path, timeframes, writer=checkpoint, batch=epoch)

    w = trades_stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
