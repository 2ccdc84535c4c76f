"""Canonical schemas of the trade and tick relations."""
from __future__ import annotations

from pyspark.sql import types as T

# Canonical `trades` relation: one row per executed trade.  `id` is the
# tie-breaker for every time-ordered operator (order = timestamp, id).
TRADES = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("size", T.DoubleType(), True),
    T.StructField("side", T.StringType(), True),
    T.StructField("exchange", T.StringType(), True),
    T.StructField("pair", T.StringType(), True),
])

# `ticks` (the market_data log): price, time, source, subject.  `id` again
# breaks timestamp ties.
TICKS = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("time", T.TimestampNTZType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("subject", T.StringType(), True),
])

# Raw message stream: one JSON document per row, tagged with its feed.
RAW_MESSAGES = T.StructType([
    T.StructField("source", T.StringType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("ingest_time", T.TimestampType(), True),
])

TRADE_ORDER = ["timestamp", "id"]
TICK_ORDER = ["time", "id"]
