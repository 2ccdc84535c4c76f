"""Readers, the checkpoint folder's rule and the dashboard's cache."""
import datetime as dt

import pytest

from ticklens import session
from ticklens.plans import dispatch
from ticklens.sources import messages, readers
from ticklens.sources.tables import load_trades

SF = "/root/testdata/sf0.001"
MATCH = '{"type":"match","price":"%d","size":"2","side":"buy"}'


def test_json_lines(spark, tmp_path):
    (tmp_path / "coinbase").mkdir()
    (tmp_path / "coinbase" / "a.jsonl").write_text("\n".join([MATCH % 1, "", "not json", MATCH % 3]))
    df = readers.read_json_lines(spark, str(tmp_path / "*"))
    assert df.columns == ["source", "raw", "ingest_time"]
    assert sorted(r.price for r in messages.normalize_trades(df).collect()) == [1.0, 3.0]
    assert [(r.source, r.reason) for r in messages.invalid_messages(df).collect()] == [("coinbase", "not_json")]
    stream = readers.read_json_lines(spark, str(tmp_path / "coinbase"), "coinbase", stream=True)
    assert stream.isStreaming and messages.normalize_trades(stream).isStreaming


def test_kafka_records(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(k, (MATCH % i).encode(), "coinbase", 0, i, at, 0) for i, k in enumerate([None, b"coinbase", b"ftx"])]
    records = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int")
    df = readers.kafka_messages(records)
    assert df.columns == ["source", "raw", "ingest_time", "topic", "partition", "offset"]
    ids = [r.id for r in messages.normalize_trades(df).collect()]
    assert len(set(ids)) == 2 and sorted(ids) == sorted(r.id for r in messages.normalize_trades(df.repartition(2)).collect())


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, *_):
            raise AssertionError("no folder may be made up")

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())


def test_dashboard_cache_is_released(spark):
    with dispatch.dashboard(load_trades(spark, SF), 43200, "2024-01-31 00:00:00") as views:
        assert not views._cached()  # nothing was asked for yet
        assert views["volume"].count() > 0
        cached = list(views._cached())
        assert cached and all(df.is_cached for df in cached)
    assert not any(df.is_cached for df in cached) and views["volume"].count() > 0
