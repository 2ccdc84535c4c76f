"""Streams on a file replay: equal to the batch operators on the same rows."""
import datetime as dt

from pyspark.sql import functions as F

from ticklens.operators import windows
from ticklens.sources.tables import load_ticks, load_trades
from ticklens.streaming import replay, streams

SF = "/root/testdata/sf0.001"


def test_session_metrics_equal_batch(spark):
    t = load_trades(spark, SF)
    got = replay.run_to_parquet(streams.stream_session_metrics(replay.replay(spark, t, "timestamp", "t1", 3)),
                                spark, "t1", "complete").first()
    exp = t.agg(F.min_by("price", F.struct("timestamp", "id")).alias("f"), F.count(F.lit(1)).alias("n"),
                F.max("price").alias("h")).first()
    assert got.trade_count == exp.n and got.high == exp.h and got.first_price == exp.f


def test_late_row_behind_watermark_is_dropped(spark, make_trades, tmp_path):
    """Spark drops a row once the watermark of an earlier batch has passed it;
    its bar was already emitted without it."""
    from ticklens.schema import TRADES
    src = str(tmp_path / "in")
    batches = [[(1, "2024-01-01 00:00:00", 1.0, 1.0, "buy"), (2, "2024-01-01 00:01:00", 2.0, 1.0, "buy")],
               [(4, "2024-01-01 00:02:00", 3.0, 1.0, "buy")],
               [(3, "2024-01-01 00:00:01", 9.0, 1.0, "buy")]]          # 3 is late
    for rows in batches:
        make_trades(rows).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(src)
    out = replay.run_to_parquet(streams.stream_bars(stream, "5 seconds", "10 seconds"), spark, "late")
    rows = {r.timestamp: (r.trade_count, r.high) for r in out.collect()}
    assert rows[dt.datetime(2024, 1, 1, 0, 0, 0)] == (1, 1.0)
    assert 9.0 not in {h for _, h in rows.values()}


def test_streaming_append_sink_equals_batch(spark, tmp_path):
    from ticklens.schema import TRADES
    from ticklens.sources import sinks
    t = load_trades(spark, SF)
    src = replay.write_chunks(t, "timestamp", str(tmp_path / "in"), 3)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(src)
        sinks.append_trades_stream(stream, out, ck).awaitTermination()

    run()
    got = spark.read.parquet(out)
    assert got.count() == t.count()
    assert got.select("id").subtract(t.select("id")).count() == 0
    run()                                   # same source + checkpoint: nothing is written twice
    assert spark.read.parquet(out).count() == t.count()


def test_dashboard_bundle(spark):
    from ticklens.plans import dispatch
    t = load_trades(spark, SF)
    with dispatch.dashboard(t, 1440, as_of="2024-01-31 00:00:00") as out:
        assert set(out) == {"price", "volatility", "distribution", "moving_averages", "volume", "volume_share", "heatmap"}
        n = out["price"].count()
        assert n > 0 and out["moving_averages"].count() == n
        assert sum(r["count"] for r in out["heatmap"].collect()) <= n - 1


def test_tick_blocked_equals_batch_window(spark, tmp_path):
    ticks = load_ticks(spark, SF)
    q = streams.stream_tick_analytics(replay.replay(spark, ticks, "time", "t4b", 4),
                                      base=str(tmp_path / "b"), checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "b" / "out"))
    exp = windows.source_analytics(ticks)
    j = got.alias("g").join(exp.alias("e"), "id")
    assert got.count() == ticks.count() == j.count()
    assert j.filter(~F.col("g.prev_price").eqNullSafe(F.col("e.prev_price"))
                    | (F.abs(F.col("g.moving_avg_5") - F.col("e.moving_avg_5")) > 1e-9)).count() == 0


def test_session_metrics_update_mode(spark):
    """T1 in update mode: each batch brings only the keys that changed, the result holds them all."""
    t = load_trades(spark, SF)
    late = t.agg(F.max("timestamp")).first()[0]
    one = t.limit(1).select(*[F.lit("ETH-USD").alias(c) if c == "pair" else F.col(c) for c in t.columns]).withColumn("timestamp", F.lit(dt.datetime(2000, 1, 1)))
    out = replay.run_to_parquet(streams.stream_session_metrics(replay.replay(spark, t.unionByName(one), "timestamp", "t1u", 3)),
                                spark, "t1u", "update", ["pair"])
    assert late is not None and {r.pair: r.trade_count for r in out.collect()} == {"BTC-USD": t.count(), "ETH-USD": 1}


def test_replay_keeps_rows_without_a_time(spark):
    t = load_trades(spark, SF)
    holes = t.withColumn("timestamp", F.when(F.col("id") % 5 > 0, F.col("timestamp")))
    got = replay.run_to_parquet(replay.replay(spark, holes, "timestamp", "holes", 3), spark, "holes")
    assert got.count() == t.count()


def test_state_folder_holds_two_versions(spark, tmp_path):
    t = load_trades(spark, SF).limit(120)
    streams.stream_retention(replay.replay(spark, t, "timestamp", "two", 6), str(tmp_path / "b"), str(tmp_path / "c"), keep=50).awaitTermination()
    import os
    assert len(os.listdir(tmp_path / "b" / "all")) >= 6 and len(os.listdir(tmp_path / "b" / "latest")) <= 2


def test_dashboard_builds_what_is_asked_for(spark, monkeypatch):
    """A plain view starts no ordered pass; with the cache all views come from one read and one pass."""
    from ticklens.operators import windows as w
    from ticklens.plans import dispatch
    passes = []
    monkeypatch.setattr(w, "ordered_window", lambda *a, f=w.ordered_window, **k: passes.append(1) or f(*a, **k))
    t = load_trades(spark, SF)
    plain = dispatch.dashboard(t, 43200, "2024-01-31 00:00:00", persist=False)
    assert plain["volume"].count() == 3 and not passes
    expected = {name: sorted(map(str, plain[name].collect())) for name in plain}
    del passes[:]
    with dispatch.dashboard(t, 43200, "2024-01-31 00:00:00") as cached:
        assert not passes
        got = {name: sorted(map(str, cached[name].collect())) for name in cached}
        assert len(passes) == 1
        for name in cached:
            plan = cached[name]._jdf.queryExecution().withCachedData().toString()
            assert "InMemoryRelation" in plan
    rounded = lambda rows: [[round(float(x), 6) for x in __import__("re").findall(r"-?\d+\.\d+(?:e-?\d+)?", r)] for r in rows]
    assert set(got) == set(expected)
    for name in got:
        assert len(got[name]) == len(expected[name])
        if name not in ("volume", "volume_share"):
            assert rounded(got[name]) == rounded(expected[name])


def test_tick_state_is_constant_and_survives_a_restart(spark, make_ticks, tmp_path):
    rows = [(i, None if i % 11 == 5 else float(i * i % 17), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "NEX Stream" if i % 3 else "Coinbase", "s") for i in range(90)]
    ticks = make_ticks(rows)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    sizes = []
    for a in range(0, 90, 30):  # each run stops and the next goes on
        ticks.filter(F.col("id").between(a, a + 29)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (streams.stream_tick_state(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        sizes.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
    assert sizes == [2, 2, 2]
    exp = windows.source_analytics(ticks)
    j = spark.read.parquet(out).alias("g").join(exp.alias("e"), "id")
    assert j.count() == 90 and spark.read.parquet(out).count() == 90
    assert j.filter(~F.col("g.prev_price").eqNullSafe(F.col("e.prev_price"))
                    | ~F.round("g.moving_avg_5", 9).eqNullSafe(F.round("e.moving_avg_5", 9))).count() == 0


def test_bar_chain_counts_late_rows_within_the_watermark(spark, make_trades, tmp_path):
    from ticklens.schema import TRADES
    src = str(tmp_path / "in")
    batches = [[(1, "2024-01-01 00:00:01", 5.0, 1.0, "buy"), (2, "2024-01-01 00:00:58", 2.0, 1.0, "buy")],
               [(3, "2024-01-01 00:00:50", 9.0, 1.0, "buy"), (4, "2024-01-01 00:01:02", 3.0, 1.0, "buy")],      # 3 is late, but not too late
               [(5, "2024-01-01 00:03:00", 4.0, 1.0, "buy")], [(6, "2024-01-01 00:00:30", 100.0, 1.0, "buy")]]   # 6 comes after its bar
    for rows in batches:
        make_trades(rows).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(src)
    out = replay.run_to_parquet(streams.stream_bar_chain(stream, ("5 seconds", "1 minute"), "20 seconds"), spark, "chain")
    got = {(str(r.timestamp)[-8:], r.open, r.high, r.low, r.close, r.trade_count) for r in out.collect()}
    assert got == {("00:00:00", 5.0, 9.0, 2.0, 2.0, 3), ("00:01:00", 3.0, 3.0, 3.0, 3.0, 1)}


def test_redelivered_messages_count_once(spark, tmp_path):
    from ticklens.schema import RAW_MESSAGES
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.timezone.utc)
    text = lambda i: '{"e":"trade","T":%d,"p":"%d","q":"1","m":false}' % (1704067200000 + 1000 * i, i + 1)
    src = str(tmp_path / "in")
    batches = [[0, 1, 2], [2, 3, 1], [4, 4, 0]]
    for ids in batches:
        spark.createDataFrame([("binance", text(i), at(i)) for i in ids], RAW_MESSAGES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(RAW_MESSAGES).option("maxFilesPerTrigger", 1).parquet(src)
    out = replay.run_to_parquet(streams.stream_normalize_once(stream, "1 minute"), spark, "once")
    assert sorted(r.price for r in out.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def _batch_rows(q):
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def test_replay_writes_and_reads_a_chunk_by_many_tasks(spark, make_trades, monkeypatch, tmp_path):
    """A large table's chunks are of several files each, and still a micro-batch each, in time order."""
    monkeypatch.setattr(replay, "ROWS_PER_SLICE", 100)
    monkeypatch.setattr(replay, "ROWS_PER_FILE", 10)
    assert replay.slice_sizes(7) == (3, 1) and replay.slice_sizes(500) == (5, 10)
    rows = [(i, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", float(i), 1.0, "buy") for i in range(480)] + [(i, None, 1.0, 1.0, "buy") for i in range(480, 500)]
    t = make_trades(rows[::-1])
    dest = []
    monkeypatch.setattr(replay, "append_slices", lambda slices, d, *a, f=replay.append_slices: dest.append(d) or f(slices, d, *a))
    stream = replay.replay(spark, t, "timestamp", "many")
    assert len([f for f in (tmp_path / dest[0]).iterdir() if f.name.startswith("part-")]) == 50
    seen = []
    q = (stream.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r.id for r in b.select("id").collect())))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 5 and all(70 <= len(ids) <= 130 for ids in seen)
    assert [i for ids in seen for i in ids] == list(range(500))


def test_replay_slices_that_are_empty_keep_their_micro_batch(spark, make_trades, monkeypatch, tmp_path):
    monkeypatch.setattr(replay, "ROWS_PER_FILE", 10)
    t = make_trades([(i, "2024-01-01 00:00:00", 1.0, 1.0, "buy") for i in range(60)])  # one time: all rows in the last slice
    stream = replay.replay(spark, t, "timestamp", "ties")
    q = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert _batch_rows(q) == [60] and spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_replayed_messages_are_the_batch_messages(spark, monkeypatch):
    """Messages made by the tasks that write the chunks give the trades of the batch form, also when sent twice."""
    from ticklens.sources import feeds, messages
    from ticklens.sources.tables import read_table
    monkeypatch.setattr(replay, "ROWS_PER_SLICE", 250)
    monkeypatch.setattr(replay, "ROWS_PER_FILE", 40)
    events = read_table(spark, SF, "events")
    exp = messages.normalize_trades(feeds.raw_messages_from_events(events))
    form = feeds.raw_messages_from_events
    got = replay.run_to_parquet(streams.stream_normalize(replay.replay(spark, events, "ts", "m", form=form)), spark, "m")
    once = replay.run_to_parquet(streams.stream_normalize_once(replay.replay(spark, events.unionAll(events), "ts", "m2", form=form)), spark, "m2")
    for rows in (got, once):
        assert rows.count() == exp.count() and rows.exceptAll(exp).count() == 0


class _State:
    def __init__(self, prices=None):
        self.exists, self.get = prices is not None, (prices,)

    def update(self, value):
        self.exists, self.get = True, value


def test_tick_state_gives_a_source_in_pieces():
    """No frame of what comes out is a source's whole micro-batch; the pieces are framed as one."""
    import numpy as np
    import pandas as pd
    n = 3 * streams.TICK_PIECE + 17
    price = np.where(np.arange(n) % 13 == 4, np.nan, np.arange(n) * 7 % 101)
    whole = pd.DataFrame({"id": np.arange(n), "price": price, "time": np.datetime64("2024-01-01") + np.arange(n).astype("timedelta64[s]"),
                          "source": "a", "subject": np.where(np.arange(n) % 2 == 0, "s", "t").astype(object)})
    mixed = whole.sample(frac=1, random_state=1)
    state = _State([1.0, None])
    pieces = list(streams._tick_frames(("a",), iter([mixed[i::4] for i in range(4)]), state))
    assert max(map(len, pieces)) <= streams.TICK_PIECE
    got = pd.concat(pieces, ignore_index=True)
    assert got["id"].tolist() == list(range(n)) and got["subject"].tolist() == whole["subject"].tolist() and set(got["source"]) == {"a"}
    before = pd.Series([1.0, np.nan, *price])
    np.testing.assert_allclose(got["moving_avg_5"].astype(float), before.rolling(6, min_periods=1).mean()[2:], rtol=1e-9)
    np.testing.assert_array_equal(got["prev_price"].astype(float), before.shift()[2:])
    np.testing.assert_array_equal(np.array(state.get[0], float), price[-5:])
