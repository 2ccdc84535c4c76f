"""R1 and T5 on a stored table: trades by date, and a deletion that goes by the folders' layout.

The newest ``keep`` rows lie in the newest dates, and the manifest knows how many rows each date has.
So dates older than the one that holds the last kept row go without being read, that one date is read
and, if it loses rows, written again, and newer dates aren't touched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import values_at_ranks
from ..schema import TRADES
from .sinks import by_date
from .snapshots import SnapshotTable

STORED = T.StructType([*TRADES.fields, T.StructField("date", T.DateType(), True)])


def trade_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, STORED, ["date"])


def store_trades(trades: DataFrame, path: str, writer: str | None = None, batch: int | None = None, tasks_per_date: int = 4) -> int:
    """Append trades as a new version of the table below ``path``; a writer's batch that is in it
    already is skipped.  Returns the version."""
    table = trade_table(trades.sparkSession, path)
    base = table.manifest()
    if table.has(writer, batch, base):
        return base.version
    rows = by_date(trades, tasks_per_date).sortWithinPartitions("date", "timestamp")
    return table.write(rows, base=base, writer=writer, batch=batch).version


def stored_trades(spark: SparkSession, path: str, start=None) -> DataFrame:
    """The trades of the newest version; with ``start`` (a date) only folders from then on are listed
    and read, and that of rows without a time."""
    table = trade_table(spark, path)
    return table.read(where=lambda key: start is None or key[0] is None or key[0] >= str(start))


def retain_stored(spark: SparkSession, path: str, keep: int = 1000) -> int:
    """Delete the rows whose timestamp is not among the newest ``keep`` rows' timestamps, as a new
    version; returns how many went.  Rows tied with the last kept one all stay, as do rows without a
    time.  Deleting again deletes nothing."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    table = trade_table(spark, path)
    base = table.manifest()
    sizes = {key: sum(names.values()) for key, names in base.folders.items() if key[0] is not None}
    newer, boundary = 0, None
    for key in sorted(sizes, reverse=True):
        boundary = key
        if newer + sizes[key] >= keep:
            break
        newer += sizes[key]
    if boundary is None or newer + sizes[boundary] < keep:
        return 0  # fewer rows than that
    older = [key for key in sizes if key < boundary]
    rows = table.read(base, lambda key: key == boundary)
    wanted = keep - newer  # so many of the boundary's newest
    at, n = values_at_ranks(rows, "timestamp", "id", lambda n: [n - wanted])
    kept = rows.filter(F.col("timestamp") >= F.lit(at[n - wanted]).cast("timestamp_ntz"))
    left = kept.count()
    gone = sum(sizes[key] for key in older) + n - left
    if left < n:
        table.write(kept.sortWithinPartitions("timestamp"), base=base, replace=True, drop=older, keys=[boundary])
    elif older:
        table.drop(older, base)
    return gone


def store_trades_stream(trades_stream: DataFrame, path: str, checkpoint: str, keep: int | None = None, trigger: dict | None = None):
    """S10 + T5 on a stream: every micro-batch is appended once, whatever is run again, and with
    ``keep`` the table is cut to the newest rows after it; replaced folders are deleted then, but for
    the version before, which readers may still hold."""
    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        store_trades(batch.select(*TRADES.names), path, writer=checkpoint, batch=epoch)
        if keep is not None and retain_stored(spark, path, keep):
            trade_table(spark, path).vacuum(keep=2)

    w = trades_stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
