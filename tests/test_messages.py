"""Raw message fixtures (FIXTURES.md §2) through the normalisers."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticklens.schema import RAW_MESSAGES
from ticklens.sources import messages as M

ARRIVAL = dt.datetime(2024, 3, 1, 12, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture
def raw(spark):
    def mk(rows):
        return spark.createDataFrame([(src, txt, ARRIVAL) for src, txt in rows], RAW_MESSAGES)
    return mk


def test_coinbase(raw):
    df = raw([("coinbase", '{"type":"match","price":"50000.10","size":"0.5","side":"buy"}'),
              ("coinbase", '{"type":"subscriptions"}')])
    rows = M.norm_coinbase(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.price, r.size, r.side, r.exchange, r.pair) == (50000.10, 0.5, "buy", "coinbase", "BTC-USD")
    assert r.timestamp == dt.datetime(2024, 3, 1, 12, 0, 0)   # arrival time


def test_binance(raw):
    df = raw([("binance", '{"e":"trade","T":1704067200000,"p":"50000.10","q":"0.5","m":true}')])
    r = M.norm_binance(df).first()
    assert (r.side, r.price, r.size) == ("sell", 50000.10, 0.5)
    assert r.timestamp == dt.datetime(2024, 1, 1, 0, 0, 0)


def test_kraken_every_trade(raw):
    txt = '[12,[["50000.10","0.5","1704067200.1","b","l",""],["x","1","1","b"],["50001","0.25","1704067200.2","s","l",""]],"trade","XBT/USD"]'
    df = raw([("kraken", txt), ("kraken", '{"event":"heartbeat"}')])
    for rows in (M.norm_kraken(df).collect(), M.normalize_trades(df).collect()):
        assert sorted((r.price, r.size, r.side) for r in rows) == [(50000.10, 0.5, "buy"), (50001.0, 0.25, "sell")]
        assert len({r.id for r in rows}) == 2
    assert [(r.pos, r.reason, r.raw) for r in M.invalid_messages(df).collect()] == [(1, "bad_number", txt)]


def test_ids_are_the_same_in_every_run(spark, raw):
    rows = [("coinbase", '{"type":"match","price":"%d","size":"2","side":"buy"}' % i) for i in range(5)]
    ids = lambda df: sorted(r.id for r in M.normalize_trades(df).collect())
    df = raw(rows)
    assert ids(df) == ids(df.repartition(3)) and len(set(ids(df))) == 5
    numbered = df.withColumn("msg_id", F.col("raw").substr(26, 1).cast("long"))
    assert ids(numbered) == [i << 20 for i in range(5)]
    logged = df.withColumns({"topic": F.lit("t"), "partition": F.lit(0), "offset": F.xxhash64("raw")})
    assert len(set(ids(logged))) == 5


def test_poison_never_fails_the_job(raw):
    df = raw([("binance", '{"e":"trade","T":9223372036854775807,"p":"3","q":"1","m":false}'),
              ("plain", '{"price":1,"size":1,"timestamp":1704067200000000000}'),
              ("coinbase", '{"type":"match","price":"NaN","size":"2"}'), ("coinbase", '{"type":"match","price":"1","size":"-Infinity"}'),
              ("bus", '{"subject":"s","data":{"price":"x"}}'), ("bus", '{"subject":"s","data":{"price":1},"timestamp":"soon"}'),
              ("coinbase_ticker", '{"type":"ticker","price":"1.5","time":"yesterday"}'), ("coinbase_ticker", '{"type":"ticker","price":"?","time":"2024-01-01T00:00:00Z"}'),
              (None, '{"a":1}'), ("kraken", None)])
    assert M.normalize_trades(df).count() == 0 and M.normalize_ticks(df).count() == 0
    assert M.norm_ticker(df).count() == 0
    assert sorted(r.reason for r in M.invalid_messages(df).collect()) == ["bad_number"] * 4 + ["bad_time"] * 4 + ["not_json", "unknown_feed"]


def test_one_parse_writes_trades_and_rejects(spark, raw, tmp_path):
    df = raw([("coinbase", '{"type":"match","price":"1","size":"2","side":"buy"}'), ("coinbase", "not json")])
    M.split_messages(df, f"{tmp_path}/t", f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1 and spark.read.parquet(f"{tmp_path}/r").first().reason == "not_json"


def test_messages_flow_into_analytics(raw):
    from ticklens.operators import stats, windows
    df = raw([("binance", '{"e":"trade","T":%d,"p":"%d","q":"1","m":false}' % (1704067200000 + i, i)) for i in range(1, 9)])
    r = stats.comprehensive_stats(M.normalize_trades(df), 60, dt.datetime(2024, 1, 1, 0, 30)).first()
    assert (r.first_price, r.current_price, r.trade_count) == (1.0, 8.0, 8)
    ticks = M.norm_envelope(raw([("bus", '{"subject":"s","data":{"price":%d},"timestamp":%d}' % (i, 1704067200000 + i)) for i in range(4)]))
    assert windows.tick_analytics(ticks).count() == 4


def test_envelope_and_ticker(raw):
    df = raw([("bus", '{"subject":"market.btc-usd.trades","data":{"price":1.5},"timestamp":1704067200000}'),
              ("bus", '{"subject":"market.btc-usd.trades","data":{}}'),
              ("cb", '{"type":"ticker","price":"1.5","time":"2024-01-01T00:00:00Z"}'),
              ("cb", '{"price":"2.5","time":"2024-01-01T00:00:01Z","source":"nex_stream","subject":"x"}')])
    env = M.norm_envelope(df).orderBy("price").collect()
    assert [(r.price, r.source) for r in env] == [(0.0, "nex_stream"), (1.5, "nex_stream")]
    assert env[1].time == dt.datetime(2024, 1, 1) and env[0].time == dt.datetime(2024, 3, 1, 12)
    tk = M.norm_ticker(df).orderBy("price").collect()
    assert [(r.price, r.source, r.subject) for r in tk] == [(1.5, "Coinbase", "ticker"), (2.5, "NEX Stream", "x")]


def test_plain(raw):
    df = raw([("plain", '{"price":1.5,"size":0.1,"side":"buy","exchange":"nex","pair":"BTC-USD","timestamp":1704067200000}')])
    r = M.norm_plain(df).first()
    assert (r.price, r.size, r.side, r.exchange, r.timestamp) == (1.5, 0.1, "buy", "nex", dt.datetime(2024, 1, 1))


def test_routing_and_side_output(raw):
    df = raw([("coinbase", '{"type":"match","price":"1","size":"2","side":"buy"}'),
              ("coinbase", "not json"),
              ("coinbase", '{"type":"match","price":"abc","size":"2","side":"buy"}'),
              ("binance", '{"e":"trade","T":1704067200000,"p":"3","q":"1","m":false}'),
              ("kraken", '{"event":"heartbeat"}'),
              ("ftx", '{"price":"1"}')])
    trades = M.normalize_trades(df).collect()
    assert sorted((r.exchange, r.price) for r in trades) == [("binance", 3.0), ("coinbase", 1.0)]
    bad = sorted((r.source, r.reason) for r in M.invalid_messages(df).collect())
    assert bad == [("coinbase", "bad_number"), ("coinbase", "not_json"), ("ftx", "unknown_feed")]


def test_subject_filter_and_defaults(spark, raw):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "subject string, v int")
    assert M.subject_filter(df, ["a"]).count() == 1
    assert M.subject_filter(df, ["*"]).count() == 2
    t = spark.createDataFrame([("1.5", "x", "", None, "")], "price string, size string, side string, exchange string, pair string")
    r = M.default_fill(t).first()
    assert (r.price, r.size, r.side, r.exchange, r.pair) == (1.5, None, "unknown", "coinbase", "BTC-USD")


def test_subscribed_messages_semi_join(spark):
    msgs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "subject string, v int")
    subs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "c")], "client_id int, subject string")
    got = sorted(r.v for r in M.subscribed_messages(msgs, subs).collect())
    assert got == [1, 3]                                  # no duplicates from two 'a' clients
    star = spark.createDataFrame([(1, "*")], "client_id int, subject string")
    assert M.subscribed_messages(msgs, star).count() == 3


@pytest.mark.parametrize("source, text, trades, ticks, reasons", [
    ("coinbase", "[1, 2]", 0, 0, []), ("coinbase", "123", 0, 0, []), ("coinbase", '"match"', 0, 0, []), ("coinbase", "null", 0, 0, []), ("coinbase", "{}", 0, 0, []),
    ("coinbase", "{'type':'match','price':'1','size':'1'}", 0, 0, ["not_json"]), ("coinbase", '{"type":"match","price":NaN,"size":1}', 0, 0, ["not_json"]),
    ("coinbase", '{"type":"match","price":1,"size":', 0, 0, ["not_json"]), ("coinbase", "", 0, 0, ["not_json"]), ("coinbase", ' \n{"type":"match","price":1e2,"size":"2"}', 1, 0, []),
    ("kraken", "[1, 2", 0, 0, ["not_json"]), ("kraken", '[1,"x","trade"]', 0, 0, []), ("kraken", '[1,[],"trade"]', 0, 0, []), ("kraken", '[1,[["1"]],"trade"]', 0, 0, ["bad_number"]),
    ("kraken", ' [1,[["5","2","0","b"],[]],"trade"]', 1, 0, ["bad_number"]), ("kraken", '[1,[["5","2"]],"book"]', 0, 0, []),
    ("plain", '{"price":{"a":1},"size":1}', 0, 0, ["bad_number"]), ("plain", '{"price":true,"size":1}', 0, 0, ["bad_number"]), ("plain", '{"price":"1","size":null}', 0, 0, ["bad_number"]),
    ("plain", '{"price":1,"size":2,"timestamp":null}', 1, 0, []), ("plain", '{"price":1,"size":2,"timestamp":1.5}', 0, 0, ["bad_time"]),
    ("bus", '{"subject":"s","data":5}', 0, 1, []), ("bus", '{"subject":"s","data":{"price":null}}', 0, 1, []), ("bus", '{"subject":"s","data":{"price":"1.5"},"x":[{}]}', 0, 1, []),
    ("bus", '{"subject":"s"}', 0, 0, []), ("coinbase_ticker", '{"type":"ticker","price":1}', 0, 0, ["bad_time"]), (None, "{", 0, 0, ["not_json"]), ("x", "{}", 0, 0, ["unknown_feed"])])
def test_shapes_of_messages(raw, source, text, trades, ticks, reasons):
    df = raw([(source, text)])
    assert M.normalize_trades(df).count() == trades and M.normalize_ticks(df).count() == ticks
    assert [r.reason for r in M.invalid_messages(df).collect()] == reasons


def test_messages_are_parsed_once(raw):
    """Whatever filters follow: one parse of an object, one of an array and one of its trades."""
    df = raw([("bus", '{"subject":"s","data":{"price":1}}')])
    for out in (M.normalize_ticks(df, ["s"]), M.norm_envelope(df).filter("price > 0 AND subject = 's'"), M.normalize_trades(df).filter("price > 1")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("StructField(_bad") == 1

