"""Top-k and retention (K1, K2, R1).  Every limit here is the feature itself
(a top-N report); Spark plans them as TakeOrderedAndProject (per-partition
top-N, then a merge of N rows per partition)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import notional
from ..functions.timeframe import timeframe_filter

def _newest():
    return [F.col("timestamp").desc_nulls_last(), F.col("id").desc_nulls_last()]


def large_trades(trades: DataFrame, threshold: float = 1.0, timeframe=None, as_of=None,
                 limit: int = 100) -> DataFrame:
    """K1: trades with size >= threshold, largest first (ties: time, id), top 100."""
    t = timeframe_filter(trades, timeframe, as_of).filter(F.col("size") >= F.lit(threshold))
    top = t.orderBy(F.col("size").desc_nulls_last(), F.col("timestamp").asc_nulls_last(),
                    F.col("id").asc_nulls_last()).limit(limit)
    return top.select("timestamp", "price", "size", "side",
                      notional().alias("notional_value"))


def recent_trades(trades: DataFrame, limit: int = 100) -> DataFrame:
    """K2: the newest `limit` trades (ties broken by id), newest first."""
    return trades.orderBy(*_newest()).limit(limit) \
                 .select("timestamp", "price", "size", "side", "exchange", "pair")


def retain_latest(trades: DataFrame, keep: int = 1000) -> DataFrame:
    """Drop rows whose timestamp is not among the newest `keep` rows'
    timestamps.  Boundary ties are all kept; NULL timestamps are never dropped.

    The anti join of the reference becomes one scalar cutoff (min timestamp of
    the top-`keep` rows), evaluated once as a scalar subquery.
    """
    newest = trades.filter(F.col("timestamp").isNotNull()) \
                   .orderBy(F.col("timestamp").desc()).limit(keep)
    cutoff = newest.agg(F.min("timestamp")).scalar()
    return trades.filter((F.col("timestamp") >= cutoff) | F.col("timestamp").isNull()
                         | cutoff.isNull())
