"""Tables of folders and manifests: rollups that merge, deletion by layout, sketches; failures and repeats."""
import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklens.operators.topk import retain_latest
from ticklens.sources import rollups, sketches, trade_store
from ticklens.sources.snapshots import SnapshotTable
from ticklens.sources.tables import load_trades

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())))


def bars(spark, path):
    return rollups.read_rollups(spark, path).select(*rollups.BAR_COLUMNS)


def random_trades(make_trades, n, seed, days=3):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(days * 86400) // 40 * 40)
        made.append((i, None if rng.random() < 0.02 else str(t), None if rng.random() < 0.05 else round(rng.uniform(1, 9), 2), round(rng.random(), 3), "buy"))
    return make_trades(made)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_merge_to_what_one_batch_gives(spark, make_trades, tmp_path, seed):
    t = random_trades(make_trades, 300, seed).persist()
    path = str(tmp_path / "r")
    for batch in (0, 1, 2, 1, 0):  # the last two come again
        rollups.write_rollups(t.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(3)) == batch), path, writer="w", batch=batch)
    assert rows(bars(spark, path)) == rows(rollups.rollups(t))
    assert bars(spark, path).groupBy("timestamp", "timeframe").count().filter("count > 1").count() == 0


def test_a_later_day_keeps_the_earlier_one_and_its_files(spark, make_trades, tmp_path):
    path = str(tmp_path / "r")
    one, two = make_trades([(1, "2024-01-01 10:00:00", 1.0, 1.0, "buy")]), make_trades([(2, "2024-01-02 10:00:00", 2.0, 1.0, "buy")])
    rollups.write_rollups(one, path, ["1m", "1h"])
    before = sorted(os.listdir(f"{path}/data/timeframe=1m/date=2024-01-01"))
    rollups.write_rollups(two, path, ["1m"])
    assert sorted(os.listdir(f"{path}/data/timeframe=1m/date=2024-01-01")) == before
    assert {(str(r.timestamp), r.timeframe) for r in bars(spark, path).collect()} == {
        ("2024-01-01 10:00:00", "1m"), ("2024-01-01 10:00:00", "1h"), ("2024-01-02 10:00:00", "1m")}
    with pytest.raises(ValueError, match="no rollup timeframe"):
        rollups.write_rollups(two, path, ["2m"])


def test_empty_batch_and_empty_table(spark, make_trades, tmp_path):
    path = str(tmp_path / "r")
    assert bars(spark, path).count() == 0
    rollups.write_rollups(make_trades([]), path)
    rollups.write_rollups(make_trades([(1, "2024-01-01 10:00:00", 1.0, 1.0, "buy")]), path)
    rollups.write_rollups(make_trades([]), path)
    assert bars(spark, path).count() == 4


def test_failed_write_leaves_nothing(spark, make_trades, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    t = make_trades([(1, "2024-01-01 10:00:00", 1.0, 1.0, "buy"), (2, "2024-01-01 10:00:30", 2.0, 1.0, "buy")])
    rollups.write_rollups(t.filter("id = 1"), path, writer="w", batch=0)
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_publish", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            rollups.write_rollups(t.filter("id = 2"), path, writer="w", batch=1)
    assert {r.trade_count for r in bars(spark, path).collect()} == {1}
    rollups.write_rollups(t.filter("id = 2"), path, writer="w", batch=1)  # again: its bars count once
    assert rows(bars(spark, path)) == rows(rollups.rollups(t))
    table = rollups.rollup_table(spark, path)
    assert table.vacuum() > 0 and rows(bars(spark, path)) == rows(rollups.rollups(t)) and table.vacuum() == 0


def test_second_writer_of_a_version_raises(spark, make_trades, tmp_path):
    table = trade_store.trade_table(spark, str(tmp_path / "t"))
    base = table.manifest()
    t = make_trades([(1, "2024-01-01 10:00:00", 1.0, 1.0, "buy")]).withColumn("date", F.to_date("timestamp"))
    table.write(t, base=base)
    with pytest.raises(RuntimeError, match="another writer"):
        table.write(t, base=base)
    assert table.read().count() == 1


def test_odd_keys(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("k", T.StringType())])
    table = SnapshotTable(spark, str(tmp_path / "t"), schema, ["k"])
    keys = ["a b", "x/y=z", "{*}?", "ä%20", None, "[1]"]
    table.write(spark.createDataFrame([(i, k) for i, k in enumerate(keys)], schema))
    table.write(spark.createDataFrame([(9, "x/y=z")], schema), replace=True, keys=[("x/y=z",)])
    assert {(r.x, r.k) for r in table.read().collect()} == {(9 if k == "x/y=z" else i, k) for i, k in enumerate(keys)}
    assert table.manifest().folders.keys() == {(k,) for k in keys}
    table.drop([("a b",), (None,)])
    assert table.read().count() == 4 and table.read(where=lambda k: k == ("[1]",)).count() == 1
    assert table.vacuum() == 3


@pytest.mark.parametrize("keep", [1, 7, 60, 150, 10_000])
def test_retention_leaves_what_the_operator_leaves(spark, make_trades, tmp_path, keep):
    t = random_trades(make_trades, 200, 5, days=6).persist()  # times in steps of 40 s: ties at the cut
    path = str(tmp_path / "t")
    for batch in (0, 1, 1):
        trade_store.store_trades(t.filter(F.col("id") % 2 == batch), path, writer="w", batch=batch)
    assert rows(trade_store.stored_trades(spark, path).select(t.columns)) == rows(t)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}
    before = files()
    gone = trade_store.retain_stored(spark, path, keep)
    left = trade_store.stored_trades(spark, path).select(t.columns)
    assert rows(left) == rows(retain_latest(t, keep)) and gone == t.count() - left.count()
    written = {f.split("date=")[1][:10] for f in files() - before}
    assert len(written) <= 1  # at most the boundary date is written again
    assert trade_store.retain_stored(spark, path, keep) == 0
    table = trade_store.trade_table(spark, path)
    table.vacuum()
    assert rows(trade_store.stored_trades(spark, path).select(t.columns)) == rows(left)


def test_retention_reads_only_the_boundary_date(spark, make_trades, tmp_path):
    t = make_trades([(d * 10 + i, f"2024-01-0{d} 00:00:0{i}", 1.0, 1.0, "buy") for d in range(1, 7) for i in range(5)])
    path = str(tmp_path / "t")
    trade_store.store_trades(t, path)
    for d in (1, 2, 3, 5, 6):  # without their files the deletion still works
        for f in os.listdir(f"{path}/data/date=2024-01-0{d}"):
            for x in os.listdir(f"{path}/data/date=2024-01-0{d}/{f}"):
                os.rename(f"{path}/data/date=2024-01-0{d}/{f}/{x}", f"{tmp_path}/{d}-{f}-{x}")
    assert trade_store.retain_stored(spark, path, 12) == 18
    assert {k[0]: sum(n.values()) for k, n in trade_store.trade_table(spark, path).manifest().folders.items()} == {
        "2024-01-04": 2, "2024-01-05": 5, "2024-01-06": 5}


def test_stream_retention_repeats_nothing(spark, tmp_path):
    from ticklens.streaming import replay
    t = load_trades(spark, SF)
    src = replay.write_chunks(t, "timestamp", str(tmp_path / "in"), 4)
    path, ck = str(tmp_path / "t"), str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
        trade_store.store_trades_stream(stream, path, ck, keep=50).awaitTermination()

    run()
    once = rows(trade_store.stored_trades(spark, path).select(t.columns))
    assert once == rows(retain_latest(t, 50))
    run()
    assert rows(trade_store.stored_trades(spark, path).select(t.columns)) == once


def test_sketches_of_batches_give_quantiles_within_the_error(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=20_000), np.full(10_000, 0.25), rng.exponential(50, 10_000)])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(i) % 3000), float(v)) for i, v in enumerate(values)],
                               "id long, timestamp timestamp_ntz, price double")
    odd = spark.createDataFrame([(-1, dt.datetime(2024, 1, 1), None), (-2, dt.datetime(2024, 1, 1), float("nan")), (-3, dt.datetime(2024, 1, 1), float("inf"))], df.schema)
    path = str(tmp_path / "s")
    for batch in (0, 1, 2, 2):
        sketches.write_sketches(df.filter(F.col("id") % 3 == batch).unionByName(odd), "price", path, writer="w", batch=batch)
    qs = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = sketches.sketch_quantiles(spark, path, qs).first()
    assert got.n == len(values) and got.mean == pytest.approx(values.mean()) and got.stddev == pytest.approx(values.std(ddof=1))
    for q in qs:
        v = got[f"q_{100 * q:g}"]
        assert (values < v).mean() - sketches.RANK_ERROR <= q <= (values <= v).mean() + sketches.RANK_ERROR
    late = sketches.sketch_quantiles(spark, path, [0.5], 24 * 60, dt.datetime(2024, 1, 3)).first()
    own = values[[i for i in range(len(values)) if i % 3000 >= 1440]]
    assert late.n == len(own)
    assert sketches.sketch_quantiles(spark, str(tmp_path / "none"), [0.5]).first().asDict() == {"n": 0, "mean": None, "stddev": None, "q_50": None}
