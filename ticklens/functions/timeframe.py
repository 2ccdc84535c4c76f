"""Timeframe resolution and the `timestamp >= as_of - tf` filter (F1)."""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Named timeframes of the dashboard, in minutes ('all' = no bound).
NAMED_TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "all": None}
MAX_STATS_TIMEFRAME_MINUTES = 1440


def resolve_timeframe(timeframe) -> float | None:
    """Minutes for a numeric or named timeframe; None means the whole table."""
    if timeframe is None:
        return None
    if isinstance(timeframe, str):
        if timeframe in NAMED_TIMEFRAMES:
            return NAMED_TIMEFRAMES[timeframe]
        try:
            return float(timeframe)
        except ValueError:
            raise ValueError(f"{timeframe!r} is no timeframe; use minutes or one of {', '.join(NAMED_TIMEFRAMES)}") from None
    if isinstance(timeframe, (int, float)) and timeframe > 0:
        return timeframe
    raise ValueError(f"invalid timeframe: {timeframe!r}")


def validate_stats_timeframe(timeframe) -> None:
    """Session statistics accept a number of minutes in (0, 1440]."""
    ok = (isinstance(timeframe, (int, float)) and not isinstance(timeframe, bool)
          and 0 < timeframe <= MAX_STATS_TIMEFRAME_MINUTES)
    if not ok:
        raise ValueError(f"timeframe must be a number in (0, 1440], got {timeframe!r}")


def as_of_column(as_of) -> Column:
    """`as_of` as a TIMESTAMP_NTZ literal; None means the current time, read ONCE here so that
    every job of an operator filters by the same instant."""
    if as_of is None:
        as_of = SparkSession.active().sql("SELECT localtimestamp()").first()[0]
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.expr(f"TIMESTAMP_NTZ '{as_of}'")


def window_start(as_of, timeframe) -> Column | None:
    minutes = resolve_timeframe(timeframe)
    if minutes is None:
        return None
    micros = int(round(float(minutes) * 60_000_000))
    return as_of_column(as_of) - F.expr(f"INTERVAL {micros} MICROSECONDS")


def timeframe_filter(df: DataFrame, timeframe=None, as_of=None, ts_col: str = "timestamp") -> DataFrame:
    """Rows with `ts_col >= as_of - timeframe` (inclusive); all rows when None.

    A `date` column next to `timestamp` is the trade date by which `append_trades` partitions."""
    start = window_start(as_of, timeframe)
    if start is None:
        return df
    if dict(df.dtypes).get("date") == "date" and ts_col == "timestamp":
        df = df.filter(F.col("date") >= start.cast("date"))  # prunes the folders of a table by trade date
    return df.filter(F.col(ts_col) >= start)
