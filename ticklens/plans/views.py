"""Register the relations as SQL views and the operators as SQL table functions; run SQL text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import source_analytics

# Microseconds of a TIMESTAMP_NTZ and back by calendar fields, so that no session time zone applies,
# and (time, id) as one number that hash aggregates can order by.
_SCALARS = (
    """epoch_micros(t TIMESTAMP_NTZ) RETURNS BIGINT RETURN
       unix_date(CAST(t AS DATE)) * 86400000000 + (hour(t) * 3600L + minute(t) * 60L) * 1000000 + CAST(extract(SECOND FROM t) * 1000000 AS BIGINT)""",
    """micros_time(m BIGINT) RETURNS TIMESTAMP_NTZ RETURN
       timestampadd(MICROSECOND, m - CAST(floor(m / 86400000000) AS BIGINT) * 86400000000, CAST(date_add(DATE '1970-01-01', CAST(floor(m / 86400000000) AS INT)) AS TIMESTAMP_NTZ))""",
    """trade_order(t TIMESTAMP_NTZ, i BIGINT) RETURNS DECIMAL(38,0) RETURN
       CAST(CAST(epoch_micros(t) AS DECIMAL(18,0)) * 100000000000000000000BD + coalesce(CAST(i AS DECIMAL(20,0)) + 9223372036854775808BD, -1BD) AS DECIMAL(38,0))""",
)

# Each function reads the view `trades` as it is when a query runs; a NULL from_time takes all trades.
_TABLES = (
    """ohlc(bar_seconds BIGINT, from_time TIMESTAMP_NTZ)
       RETURNS TABLE (timestamp TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, trade_count BIGINT)
       RETURN SELECT micros_time(bar), min_by(price, o), max(price), min(price), max_by(price, o), sum(size), count(*)
              FROM (SELECT price, size, trade_order(timestamp, id) AS o, CAST(floor(epoch_micros(timestamp) / (1000000 * bar_seconds)) AS BIGINT) * 1000000 * bar_seconds AS bar
                    FROM trades WHERE from_time IS NULL OR timestamp >= from_time) GROUP BY bar""",
    """vwap(from_time TIMESTAMP_NTZ) RETURNS TABLE (vwap DOUBLE, total_volume DOUBLE, total_trades BIGINT)
       RETURN SELECT try_divide(sum(price * size), sum(size)), sum(size), count(*) FROM trades WHERE from_time IS NULL OR timestamp >= from_time""",
    # previous prices are found within hours; an hour's first trade takes the last price of the hour with trades before it
    """changes(from_time TIMESTAMP_NTZ)
       RETURNS TABLE (id BIGINT, timestamp TIMESTAMP_NTZ, price DOUBLE, prev_price DOUBLE, pct_change DOUBLE)
       RETURN WITH own AS (SELECT id, timestamp, price, CAST(floor(epoch_micros(timestamp) / 3600000000) AS BIGINT) AS h FROM trades WHERE from_time IS NULL OR timestamp >= from_time),
                   ends AS (SELECT h, max_by(price, trade_order(timestamp, id)) AS price FROM own GROUP BY h),
                   carried AS (SELECT h AS at, lag(price) OVER (ORDER BY h NULLS LAST) AS price_before FROM ends),
                   paired AS (SELECT id, timestamp, price, price_before, row_number() OVER w AS rn, lag(price) OVER w AS lagged
                              FROM own JOIN carried ON h <=> at WINDOW w AS (PARTITION BY h ORDER BY timestamp NULLS LAST, id NULLS LAST))
              SELECT id, timestamp, price, prev, try_divide(price - prev, prev) * 100
              FROM (SELECT *, CASE WHEN rn = 1 THEN price_before ELSE lagged END AS prev FROM paired)""",
)


ANALYTICS = "market_analytics"


def register_views(spark: SparkSession, trades: DataFrame | None = None, ticks: DataFrame | None = None) -> list[str]:
    """Register `trades`, `ticks` and `market_analytics` (W7 over ticks)."""
    names = []
    if trades is not None:
        trades.createOrReplaceTempView("trades")
        names.append("trades")
    if ticks is not None:
        ticks.createOrReplaceTempView("ticks")
        source_analytics(ticks).createOrReplaceTempView(ANALYTICS)
        names += ["ticks", ANALYTICS]
    return names


def register_functions(spark: SparkSession) -> list[str]:
    """Register the SQL functions `ohlc(bar_seconds, from_time)`, `vwap(from_time)` and
    `changes(from_time)` over the view `trades`, which must exist; they are expanded into the query
    that calls them, so Spark plans and prunes it as a whole, over the rows there are then."""
    for body in (*_SCALARS, *_TABLES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return [body.split("(")[0] for body in _TABLES]


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """Free-form SQL over the registered views and functions (planned by Catalyst); `:name` markers in
    the text take the values of `parameters`.

    A text that names `market_analytics` has it planned anew, over the `ticks` of now: its split points
    belong to the rows that it was planned for.
    """
    if ANALYTICS in text.lower() and spark.catalog.tableExists("ticks"):
        source_analytics(spark.table("ticks")).createOrReplaceTempView(ANALYTICS)
    return spark.sql(text, args=parameters or None)
