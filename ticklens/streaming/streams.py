"""Structured Streaming operators.

* T6 normalisation is the batch code (:mod:`ticklens.sources.messages`) —
  stateless projections work unchanged on a streaming DataFrame.
* T1/T2 are one keyed streaming aggregate (state = one row per pair).
* T3 bars use an event-time watermark and tumbling windows in append mode; a
  chain of such windows builds longer bars from shorter ones in one query.
* T4: row-frame windows are not allowed on streams.  Two forms: a keyed state
  that holds each source's last prices (constant state, one task for a source
  in a micro-batch), and, where one source is too much for a task,
  `foreachBatch` with the distributed ordered window on each micro-batch plus
  the previous epoch's last five rows per source (a small versioned state table).
* T5 appends each micro-batch and keeps a bounded "latest" table via
  `foreachBatch` (versioned folders, idempotent on retry).
"""
from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pandas.api.types import union_categoricals
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import instant_to_ntz, ntz_to_instant, order_key, time_key
from ..operators.topk import retain_latest
from ..plans.ordered import INDEX_COL, ordered_window
from ..sources import messages
from ..sources.rollups import merged_bars

# Bar width of the live chart and the tick frame (6 rows =
# current + 5 preceding).
LIVE_BAR = "5 seconds"
TICK_FRAME_PRECEDING = 5


def stream_normalize(raw_stream: DataFrame) -> DataFrame:
    """Raw `(source, raw, ingest_time)` stream -> trades stream."""
    return messages.normalize_trades(raw_stream)


def stream_normalize_once(raw_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Trades of a feed that may deliver a message again: each trade id once.

    State holds the ids of the last `delay` of event time; a redelivery within that time is dropped by
    its id, a later one as late data.  A trade without a time of its own counts at its arrival.
    """
    good = messages.good_trades(messages.parse_messages(raw_stream))
    event = F.coalesce(ntz_to_instant("timestamp"), F.col("ingest_time"))
    return (good.withColumn("_event", event).withWatermark("_event", delay)
            .dropDuplicatesWithinWatermark(["id"]).select(*messages.TRADE_COLS))


def _truthy(price):
    return F.when(price.isNotNull() & (price != 0) & ~F.isnan(price), price)


def stream_session_metrics(trades_stream: DataFrame, key: str = "pair") -> DataFrame:
    """T1 + T2: running first, current, high, low price, change %, trade count
    and last update per `key`, since the stream started.  Rows without a
    usable price are counted but skipped for the price figures; first/current
    follow event time (timestamp, id)."""
    price = _truthy(F.col("price"))
    order = F.when(price.isNotNull(), time_key())
    has_ingest = "ingest_time" in trades_stream.columns
    last = F.max("ingest_time") if has_ingest else F.max(ntz_to_instant("timestamp"))
    agg = trades_stream.groupBy(key).agg(
        F.min_by(price, order).alias("first_price"), F.max_by(price, order).alias("current_price"),
        F.max(price).alias("high"), F.min(price).alias("low"),
        F.count(F.lit(1)).alias("trade_count"), last.alias("last_update"))
    change = F.try_divide(F.col("current_price") - F.col("first_price"), F.col("first_price")) * F.lit(100.0)
    return agg.withColumn("change_percent", change)


def stream_bars(trades_stream: DataFrame, width: str = LIVE_BAR, watermark: str = "10 seconds") -> DataFrame:
    """Tumbling event-time bars (avg, open, high, low, close, volume,
    count) of one timestamp and width.

    In append mode a bar comes out once, when the watermark passes its end; in update mode also
    the bars that are still open, again with every micro-batch that changes them (the live chart)."""
    ev = trades_stream.withColumn("event_time", ntz_to_instant("timestamp"))
    key = order_key(F.unix_micros("event_time"))
    return (ev.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", width).alias("w"))
            .agg(F.avg("price").alias("price"), F.min_by("price", key).alias("open"),
                 F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", key).alias("close"), F.sum("size").alias("volume"),
                 F.count(F.lit(1)).alias("trade_count"))
            .select(instant_to_ntz(F.col("w.start")).alias("timestamp"),
                    instant_to_ntz(F.col("w.end")).alias("bar_end"),
                    "price", "open", "high", "low", "close", "volume", "trade_count"))


def stream_bar_chain(trades_stream: DataFrame, widths: Sequence[str] = (LIVE_BAR, "1 minute", "1 hour"),
                     watermark: str = "10 seconds") -> DataFrame:
    """Closed bars of the last of `widths`, built from those of the width before it and so on, by
    chained aggregations under one watermark (append mode).

    Only the shortest bars' aggregate sees trades.  Every width must be a multiple of the one before.
    A trade late by up to `watermark` still counts; a bar comes out when all shorter bars in it have.
    """
    ev = trades_stream.withColumn("event_time", ntz_to_instant("timestamp"))
    key = order_key(F.unix_micros("event_time"))
    price = F.col("price")
    bars = ev.withWatermark("event_time", watermark).select(
        "event_time", price.alias("open_price"), key.alias("open_key"), price.alias("high_price"), price.alias("low_price"),
        price.alias("close_price"), key.alias("close_key"), F.col("size").alias("volume"), F.lit(1).cast("long").alias("trade_count"))
    time = F.col("event_time")
    for width in widths:
        bars = merged_bars(bars, F.window(time, width).alias("w"))
        time = F.window_time("w")
    return bars.select(instant_to_ntz(F.col("w.start")).alias("timestamp"), instant_to_ntz(F.col("w.end")).alias("bar_end"),
                       F.col("open_price").alias("open"), F.col("high_price").alias("high"), F.col("low_price").alias("low"),
                       F.col("close_price").alias("close"), "volume", "trade_count")


TICK_PIECE = 10_000  # rows of a source that are framed and given to Spark at a time
TICK_FRAME = "id long, price double, time timestamp_ntz, source string, subject string, moving_avg_5 double, prev_price double"


def _tick_frames(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A source's new rows in (time, id) order after its last prices, which are all that is kept.

    What is held of the micro-batch is plain numbers and each different subject once; rows come out in pieces.
    """
    held = np.array(state.get[0], float) if state.exists else np.empty(0)  # a missing price is NaN here
    columns: dict[str, list] = {"id": [], "time": [], "price": [], "subject": []}
    for f in frames:  # copies: a column of a frame keeps its whole Arrow batch
        for name in ("id", "time"):
            columns[name].append(f[name].to_numpy(copy=True))
        columns["price"].append(f["price"].to_numpy(float, copy=True))
        columns["subject"].append(f["subject"].astype("category"))
    subjects = union_categoricals(columns.pop("subject"))
    ids, times, prices = (np.concatenate(columns.pop(name)) for name in ("id", "time", "price"))
    order = np.lexsort((ids, times))
    prices = np.concatenate([np.full(TICK_FRAME_PRECEDING - len(held), np.nan), held, prices[order]])
    state.update((prices[-TICK_FRAME_PRECEDING:][-(len(held) + len(order)):].tolist(),))
    for a in range(0, len(order), TICK_PIECE):
        at = order[a:a + TICK_PIECE]
        frame = np.lib.stride_tricks.sliding_window_view(prices[a:a + len(at) + TICK_FRAME_PRECEDING], TICK_FRAME_PRECEDING + 1)
        known = ~np.isnan(frame)
        with np.errstate(invalid="ignore"):
            avg = np.where(known, frame, 0).sum(axis=1) / known.sum(axis=1)
        rows = pd.DataFrame({"id": ids[at], "price": frame[:, -1], "time": times[at], "source": key[0], "subject": subjects[at].astype(object),
                             "moving_avg_5": avg, "prev_price": frame[:, -2]})
        yield rows.astype(object)  # NaN and NaT become NULL


def stream_tick_state(ticks_stream: DataFrame) -> DataFrame:
    """T4 with keyed state: per source, moving_avg_5 (current + 5 preceding prices) and prev_price.

    The state is a ring of each source's last five prices: its size is the number of sources, however
    long the query runs, and a restart goes on from the checkpoint.  A source's rows of one micro-batch
    meet in one task, which holds some tens of bytes of each, so bound the trigger, or use :func:`stream_tick_analytics`.  A source's rows must
    arrive in time order across micro-batches; NaN prices count as missing.
    """
    rows = ticks_stream.select("id", "price", "time", "source", "subject")
    return rows.groupBy("source").applyInPandasWithState(_tick_frames, TICK_FRAME, "prices array<double>", "append", "NoTimeout")


def stream_tick_analytics(ticks_stream: DataFrame, base: str, checkpoint: str, trigger: dict | None = None):
    """T4: per source, moving_avg_5 (current + 5 preceding prices) and
    prev_price on a stream.

    Starts a `foreachBatch` query writing `base/out/epoch=<id>` and returns the
    StreamingQuery; each micro-batch is windowed with the distributed ordered
    window, continuing from the state table `base/state/v<epoch>` (last five
    rows per source).  A source's rows must arrive in time order across
    micro-batches.
    """
    cols = ["id", "price", "time", "source", "subject"]

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        prev = _previous(spark, os.path.join(base, "state"), epoch)
        rows = batch.select(*cols).withColumn("_carry", F.lit(False))
        if prev is not None:
            rows = rows.unionByName(spark.read.parquet(prev).select(*cols).withColumn("_carry", F.lit(True)))
        # the count, the key sample and the window all read this epoch's input
        rows = rows.persist()
        framed = ordered_window(rows, ["time", "id"], lambda w: {
            "moving_avg_5": F.avg("price").over(w.rowsBetween(-TICK_FRAME_PRECEDING, 0)),
            "prev_price": F.lag("price").over(w),
        }, halo=TICK_FRAME_PRECEDING, partition_by=["source"], keep_index=True, n=rows.count())
        # two outputs from one framed batch: keep it (bounded by the trigger;
        # recomputable from the batch lineage if an executor is lost)
        framed = framed.persist()
        try:
            (framed.filter(~F.col("_carry")).select(*cols, "moving_avg_5", "prev_price")
             .write.mode("overwrite").parquet(os.path.join(base, "out", f"epoch={epoch}")))
            # new state: the last five rows of every source (index > last - 5)
            last = framed.groupBy("source").agg(F.max(INDEX_COL).alias("_last"))
            tail = (framed.join(last, "source")
                    .filter(F.col(INDEX_COL) > F.col("_last") - TICK_FRAME_PRECEDING).select(*cols))
            tail.write.mode("overwrite").parquet(os.path.join(base, "state", f"v{epoch:012d}"))
        finally:
            framed.unpersist()
            rows.unpersist()

    w = ticks_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_retention(trades_stream: DataFrame, base: str, checkpoint: str, keep: int = 1000,
                     trigger: dict | None = None):
    """T5: write every micro-batch to `base/all/epoch=<id>` and maintain
    `base/latest/v<epoch>` = R1(previous latest + batch).  Both are written
    whole per epoch (overwrite), so a retried batch rewrites the same folders
    instead of appending twice."""
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        prev = _previous(spark, os.path.join(base, "latest"), epoch)
        batch = batch.persist()  # the source is read once for both outputs
        try:
            batch.write.mode("overwrite").parquet(os.path.join(base, "all", f"epoch={epoch}"))
            merged = batch if prev is None else spark.read.parquet(prev).unionByName(batch)
            retain_latest(merged, keep).write.mode("overwrite").parquet(os.path.join(base, "latest", f"v{epoch:012d}"))
        finally:
            batch.unpersist()

    w = trades_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def latest_version(spark, base: str, before: int | None = None) -> str | None:
    """Path of the newest complete `latest` version (optionally older than `before`)."""
    return _latest(spark, os.path.join(base, "latest"), before)


def _previous(spark, root: str, epoch: int) -> str | None:
    """The state that the epoch before left, by name; the one before that is no longer needed by
    any retry and is deleted, so the folder holds two versions however long the query runs."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if epoch >= 2:
        fs.delete(jvm.org.apache.hadoop.fs.Path(os.path.join(root, f"v{epoch - 2:012d}")), True)
    before = os.path.join(root, f"v{epoch - 1:012d}")
    return before if epoch and fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(before, "_SUCCESS"))) else None


def _latest(spark, root: str, before: int | None = None) -> str | None:
    """Newest complete `v<epoch>` folder under `root` (older than `before`)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    names = sorted(st.getPath().getName() for st in fs.listStatus(path)
                   if st.getPath().getName().startswith("v"))
    ok = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(root, n, "_SUCCESS")))]
    if before is not None:
        ok = [n for n in ok if int(n[1:]) < before]
    return os.path.join(root, ok[-1]) if ok else None
