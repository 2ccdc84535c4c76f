"""Volume breakdowns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeframe import timeframe_filter


def volume_by_side(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """Per side: volume, trade_count, avg_trade_size; by volume descending."""
    t = timeframe_filter(trades, timeframe, as_of)
    return (t.groupBy("side")
            .agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
                 F.avg("size").alias("avg_trade_size"))
            .orderBy(F.col("volume").desc_nulls_last()))


def volume_share(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """Buy and sell volume and their share of buy + sell (other sides
    ignored, an absent side counts 0).  Two rows: 'Buy', 'Sell'."""
    t = timeframe_filter(trades, timeframe, as_of)
    size = F.coalesce(F.col("size"), F.lit(0.0))
    agg = t.agg(F.coalesce(F.sum(F.when(F.col("side") == "buy", size)), F.lit(0.0)).alias("b"),
                F.coalesce(F.sum(F.when(F.col("side") == "sell", size)), F.lit(0.0)).alias("s"))
    rows = agg.select(F.expr("stack(2, 'Buy', b, 'Sell', s) AS (side, volume)"),
                      (F.col("b") + F.col("s")).alias("_total"))
    return rows.select("side", "volume",
                       (F.try_divide(F.col("volume"), F.col("_total")) * F.lit(100.0)).alias("percentage"))


def vwap(trades: DataFrame, timeframe=None, as_of=None) -> DataFrame:
    """D3: SUM(price*size)/SUM(size), total_volume, total_trades."""
    t = timeframe_filter(trades, timeframe, as_of)
    return t.agg(F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
                 F.sum("size").alias("total_volume"), F.count(F.lit(1)).alias("total_trades"))
