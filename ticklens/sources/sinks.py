"""Sinks: trade appends (S10).  Stored rollups are in :mod:`.rollups`, a table with retention in :mod:`.trade_store`.

Paths are folders under the cluster's shared storage (callers pass them; the
tests use a scratch folder).  Writes go through Spark's committers, so a lost
executor re-runs its task without duplicating output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RECORDS_PER_FILE = 5_000_000


def by_date(trades: DataFrame, tasks_per_date: int = 4) -> DataFrame:
    """Trades with their `date`, clustered by it: a date's rows in at most `tasks_per_date` tasks, so
    that a hot day is not one task's."""
    dated = trades.withColumn("date", F.to_date("timestamp"))
    return dated.repartition("date", F.pmod(F.xxhash64("timestamp", "id"), F.lit(tasks_per_date)))


def append_trades(trades: DataFrame, path: str, tasks_per_date: int = 4) -> None:
    """S10 (batch): append trades to a parquet table partitioned by trade date.

    An append writes at most `tasks_per_date` files for each date, sorted by time, so that a later
    timeframe filter skips row groups, not only date folders; files are capped in size.
    """
    (by_date(trades, tasks_per_date).sortWithinPartitions("date", "timestamp")
     .write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy("date").parquet(path))


def append_trades_stream(trades_stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, tasks_per_date: int = 4):
    """S10 (stream): the micro-batch append, clustered by date like the batch form; the checkpoint gives
    exactly-once output (replaces the reference's buffer and its lost-row race)."""
    w = (by_date(trades_stream, tasks_per_date)
         .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("date").outputMode("append"))
    return w.trigger(**(trigger or {"availableNow": True})).start()
