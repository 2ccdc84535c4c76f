"""Hand-computed edge cases (FIXTURES.md §4)."""
import pytest
from pyspark.sql import functions as F

from ticklens.operators import bars, distribution, stats, topk, volatility, volume, windows
from ticklens.plans import dispatch

AS_OF = "2024-01-31 00:00:00"


def test_empty_table_stats(make_trades):
    t = make_trades([])
    r = stats.comprehensive_stats(t, 60, AS_OF).first()
    assert r.trade_count == 0 and r.first_price == 0 and r.current_price == 0 and r.change_percent == 0
    assert r.session_high is None
    assert stats.first_price(t, 60, AS_OF).count() == 0
    assert distribution.price_histogram(t).count() == 0
    assert volatility.population_volatility(t).count() == 0


def test_one_row(make_trades):
    t = make_trades([(1, "2024-01-30 12:00:00", 10.0, 1.0, "buy")])
    v = volatility.basic_volatility(t).first()
    assert v.sample_size == 0 and v.volatility is None
    assert stats.comprehensive_stats(t, 1440, AS_OF).first().change_percent == 0.0
    assert windows.moving_averages(t).first().ma_10 == 10.0


def test_equal_timestamps_ids_decide(make_trades):
    t = make_trades([(2, "2024-01-30 12:00:00", 20.0, 1.0, "buy"), (1, "2024-01-30 12:00:00", 10.0, 1.0, "sell"),
                     (3, "2024-01-30 12:00:00", 30.0, 1.0, "buy")])
    r = stats.comprehensive_stats(t, 1440, AS_OF).first()
    assert (r.first_price, r.current_price) == (10.0, 30.0)
    assert r.change_percent == pytest.approx(200.0)
    ch = {x.id: x.prev_price for x in windows.price_changes(t).collect()}
    assert ch == {1: None, 2: 10.0, 3: 20.0}
    o = bars.ohlc_bars(t, "minute").first()
    assert (o.open, o.close, o.volume) == (10.0, 30.0, 3)


def test_constant_price_bins(make_trades):
    t = make_trades([(i, f"2024-01-30 12:00:0{i}", 5.0, 1.0, "buy") for i in range(4)])
    d4 = distribution.volume_distribution(t, 10).collect()
    assert len(d4) == 10 and all(r.trade_count == 0 and r.volume == 0 for r in d4)
    d6 = distribution.price_distribution_closed(t, 10).collect()
    assert [r["count"] for r in d6] == [0] * 9 + [4]
    d7 = distribution.price_histogram(t, 10).collect()
    assert all(r["count"] == 0 for r in d7)


def test_only_sells(make_trades):
    t = make_trades([(1, "2024-01-30 12:00:00", 5.0, 2.0, "sell"), (2, "2024-01-30 12:00:01", 6.0, 1.0, "sell")])
    rows = {r.side: (r.volume, r.percentage) for r in volume.volume_share(t).collect()}
    assert rows == {"Buy": (0.0, 0.0), "Sell": (3.0, 100.0)}


def test_null_price_size_side(make_trades):
    t = make_trades([(1, "2024-01-30 12:00:00", None, 1.0, None), (2, "2024-01-30 12:00:01", 4.0, None, "buy"),
                     (3, "2024-01-30 12:00:02", 6.0, 2.0, "buy")])
    v = volume.vwap(t).first()
    # SUM(price*size) skips the NULL-price row, SUM(size) does not: 12 / 3
    assert v.vwap == pytest.approx(4.0) and v.total_trades == 3
    sides = {r.side: r["count"] for r in stats.side_summary(t).collect()}
    assert sides == {None: 1, "buy": 2}


def test_zero_price_division(make_trades):
    t = make_trades([(1, "2024-01-30 12:00:00", 0.0, 1.0, "buy"), (2, "2024-01-30 12:00:01", 4.0, 1.0, "buy")])
    rows = {r.id: r.pct_change for r in windows.price_changes(t).collect()}
    assert rows == {1: None, 2: None}


def test_fewer_rows_than_window(make_trades):
    t = make_trades([(i, f"2024-01-30 12:00:0{i}", float(i + 1), 1.0, "buy") for i in range(5)])
    assert windows.moving_averages_full(t).count() == 0
    f = windows.moving_averages_filled(t).collect()
    assert all(r.ma_10 == r.price for r in f)
    assert windows.trailing_price_volatility(t).count() == 0


def test_bin_edges_and_max(make_trades):
    # min 0, max 10, 10 bins: 5.0 sits exactly on the edge of bin 5; 10.0 is the max
    t = make_trades([(1, "2024-01-30 12:00:00", 0.0, 1.0, "buy"), (2, "2024-01-30 12:00:01", 5.0, 2.0, "buy"),
                     (3, "2024-01-30 12:00:02", 10.0, 4.0, "buy")])
    d4 = distribution.volume_distribution(t, 10).collect()
    assert [r.trade_count for r in d4] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0]   # max dropped (half-open)
    d6 = distribution.price_distribution_closed(t, 10).collect()
    assert [r["count"] for r in d6] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1]      # last bin closed
    d7 = distribution.price_histogram(t, 10).collect()
    assert [r["count"] for r in d7] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1]      # clamped


def test_row_exactly_at_window_start_is_kept(make_trades):
    t = make_trades([(1, "2024-01-30 00:00:00", 1.0, 1.0, "buy"), (2, "2024-01-29 23:59:59", 2.0, 1.0, "buy")])
    r = stats.session_stats(t, 1440, AS_OF).first()
    assert r.trade_count == 1 and r.session_high == 1.0


def test_retention_ties_at_cutoff(make_trades):
    rows = [(i, "2024-01-30 12:00:00", 1.0, 1.0, "buy") for i in range(3)]
    rows += [(10 + i, f"2024-01-30 11:00:0{i}", 1.0, 1.0, "buy") for i in range(3)]
    rows += [(99, None, 1.0, 1.0, "buy")]
    kept = {r.id for r in topk.retain_latest(make_trades(rows), keep=2).collect()}
    assert kept == {0, 1, 2, 99}


def test_dispatch_validation(make_trades):
    t = make_trades([(1, "2024-01-30 12:00:00", 1.0, 1.0, "buy")])
    with pytest.raises(ValueError):
        dispatch.trade_stats(t, 2000)
    with pytest.raises(ValueError):
        dispatch.volume_analysis(t, 60, "nope")
    with pytest.raises(ValueError):
        bars.aggregated_price(t, "week")
    assert dispatch.auto_unit(30) == "second" and dispatch.auto_unit(120) == "minute"
    assert dispatch.auto_unit(2000) == "hour"
    assert dispatch.price_data(t, 60, "none", as_of="2024-01-30 12:30:00").count() == 1
    assert dispatch.price_data(t, 60, "none").count() == 0   # as_of defaults to now


def test_value_at_risk_matches_interpolation(make_trades):
    prices = [10.0, 11.0, 9.9, 12.0, 12.0, 8.0, 9.0]
    t = make_trades([(i, f"2024-01-30 12:00:0{i}", p, 1.0, "buy") for i, p in enumerate(prices)])
    r = volatility.value_at_risk(t, 0.95).first()
    import numpy as np
    pct = [(b - a) / a * 100 for a, b in zip(prices, prices[1:])]
    assert r.var_95 == pytest.approx(float(np.percentile(pct, 5, method="linear")))
    assert r.sample_size == 6
    a = volatility.value_at_risk(t, 0.95, approx=True).first()
    assert a.var_95 in pct and a.sample_size == 6


def test_source_filter_prefix(make_ticks):
    ticks = make_ticks([(1, 1.0, "2024-01-01 00:00:00", "NEX Stream", "s"), (2, 2.0, "2024-01-01 00:00:01", "Coinbase", "t")])
    from ticklens.operators import filters
    assert [r.id for r in filters.source_filter(ticks, "nex").collect()] == [1]
    assert filters.source_filter(ticks, "both").count() == 2


def test_dispatch_covers_every_analysis(spark, make_trades):
    rows = [(i, f"2024-01-30 12:{i:02d}:00", float(10 + (i % 7)), 0.5 + i % 3, "buy" if i % 2 else "sell")
            for i in range(30)]
    t = make_trades(rows)
    for a in dispatch.VOLUME_ANALYSES:
        assert dispatch.volume_analysis(t, 1440, a, as_of=AS_OF).count() >= 1
    for a in dispatch.VOLATILITY_ANALYSES:
        assert dispatch.volatility_analysis(t, 1440, a, as_of=AS_OF).count() >= 1
    with pytest.raises(ValueError):
        dispatch.volatility_analysis(t, 1440, "nope")


def test_views_and_table_exists(spark, make_trades, make_ticks):
    from ticklens.plans import views
    t = make_trades([(1, "2024-01-30 12:00:00", 1.0, 1.0, "buy")])
    ticks = make_ticks([(1, 1.0, "2024-01-01 00:00:00", "NEX Stream", "s")])
    assert set(views.register_views(spark, t, ticks)) == {"trades", "ticks", "market_analytics"}
    assert stats.table_exists(spark, "market_analytics")
    assert views.run_sql(spark, "SELECT COUNT(*) AS n FROM trades").first().n == 1
    make_ticks([(i, float(i), f"2024-01-01 00:00:0{i}", "NEX Stream", "s") for i in range(7)]).createOrReplaceTempView("ticks")  # grown
    grown = views.run_sql(spark, "SELECT price, prev_price, moving_avg_5 FROM market_analytics ORDER BY time").collect()
    assert [tuple(r) for r in grown][-2:] == [(5.0, 4.0, 2.5), (6.0, 5.0, 3.5)] and len(grown) == 7


def test_timeframe_resolution():
    from ticklens.functions.timeframe import resolve_timeframe, validate_stats_timeframe
    assert [resolve_timeframe(x) for x in ("1m", "5m", "15m", "1h", "all")] == [1, 5, 15, 60, None]
    with pytest.raises(ValueError, match="use minutes or one of"):
        resolve_timeframe("weird")
    assert resolve_timeframe(None) is None and resolve_timeframe(90) == 90
    assert resolve_timeframe("30") == 30.0
    with pytest.raises(ValueError):
        resolve_timeframe(-1)
    validate_stats_timeframe(1440)
    for bad in (0, 1441, "60", True):
        with pytest.raises(ValueError):
            validate_stats_timeframe(bad)


def test_named_timeframe_filter(make_trades):
    from ticklens.functions.timeframe import timeframe_filter
    t = make_trades([(1, "2024-01-30 23:59:30", 1.0, 1.0, "buy"), (2, "2024-01-30 23:50:00", 2.0, 1.0, "buy"),
                     (3, "2024-01-30 22:00:00", 3.0, 1.0, "buy")])
    ids = lambda tf: sorted(r.id for r in timeframe_filter(t, tf, AS_OF).collect())
    assert ids("1m") == [1] and ids("15m") == [1, 2] and ids("1h") == [1, 2] and ids("all") == [1, 2, 3]
    assert stats.pair_stats(t, "all", AS_OF).first().trade_count == 3      # 'all' = everything


def test_change_intensity_and_its_guard(make_trades):
    rows = [(i, f"2024-01-30 12:00:{i:02d}", float(10 + i % 4), 1.0, "buy") for i in range(10)]
    assert distribution.change_intensity(make_trades(rows)).count() == 9      # no size switch by default
    assert distribution.change_intensity(make_trades(rows), min_rows=10).count() == 0
    rows.append((10, "2024-01-30 12:00:10", 8.0, 1.0, "sell"))
    out = distribution.change_intensity(make_trades(rows), min_rows=10).collect()
    assert len(out) == 10 and max(r.intensity for r in out) == 1.0
    assert {r.direction for r in out} == {"negative", "positive"}


def test_order_key_orders_as_the_struct(spark):
    from ticklens.functions.exprs import time_key
    ids = [None, -(1 << 63), -1, 0, 1, 10**18, (1 << 63) - 1]
    rows = [(i, t) for t in ("0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-01-01 00:00:00", "9999-12-31 23:59:59.999999") for i in ids]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.expr("cast(t as timestamp_ntz)").alias("timestamp"))
    by = lambda *c: [tuple(r) for r in df.orderBy(*c).collect()]
    assert by(time_key()) == by(F.struct("timestamp", "id")) and df.filter(time_key().isNull()).count() == 0
    assert df.limit(1).select(time_key(F.lit(None).cast("timestamp_ntz"))).first()[0] is None


def test_as_of_now_is_read_once(spark):
    """The default as_of is one literal: rows at the live edge give the same answer in every job."""
    live = spark.range(4000).select("id", (F.expr("localtimestamp()") - F.expr("INTERVAL 59 MINUTES 58 SECONDS")
                                           + F.expr("make_dt_interval(0, 0, 0, id / 1000)")).alias("timestamp"),
                                    F.col("id").cast("double").alias("price"), F.lit(1.0).alias("size"), F.lit("buy").alias("side"),
                                    F.lit("coinbase").alias("exchange"), F.lit("BTC-USD").alias("pair"))
    r = stats.price_dispersion(live, 60).first()
    assert r.total_records > 0 and r.median_price is not None
    assert windows.rolling_volatility(live, timeframe=60).count() >= 0 and distribution.change_intensity(live, 60).count() >= 0


def test_date_filter_prunes_the_appended_table(spark, make_trades, tmp_path):
    from ticklens.functions.timeframe import timeframe_filter
    from ticklens.sources import sinks
    t = make_trades([(i, f"2024-01-{1 + i % 28:02d} 12:00:00", float(i), 1.0, "buy") for i in range(560)]).repartition(8)
    sinks.append_trades(t, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("date=*/*.parquet"))) <= 28 * 4
    near = timeframe_filter(stored, 60, "2024-01-20 12:30:00")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and near.count() == t.filter("timestamp >= timestamp_ntz'2024-01-20 11:30:00'").count()


@pytest.mark.parametrize("prices", [[1.0], [2.5, 2.5, 2.5], [0.0, 0.0], [-3.7, -1.2, -0.05], [-1.0, 0.0, 1.0], [0.001, 0.0013, 0.0029], [10.0, 20.0],
                                    [99.5, 100.0, 123456.7], [1e-9, 5e8], [None, 4.0, float("nan"), float("inf"), 6.0], [None], []])
def test_rounded_histogram(spark, prices):
    """Edges are multiples of 1, 2 or 5 times a power of ten; every finite price is in its bin once."""
    import math
    from ticklens.operators import distribution
    from ticklens.schema import TICKS
    ticks = spark.createDataFrame([(i, p, None, "ab"[i % 2], None) for i, p in enumerate(prices)], TICKS)
    got = distribution.histogram_by_source(ticks, 20).collect()
    finite = [(p, "ab"[i % 2]) for i, p in enumerate(prices) if p is not None and math.isfinite(p)]
    assert sum(r["count"] for r in got) == len(finite)
    if not finite:
        return
    lo, hi = min(finite)[0], max(finite)[0]
    for r in got:
        if lo == hi:
            assert (r.bin_number, r.bin_start) == (0, lo)
            continue
        assert r["count"] == sum(s == r.source and r.bin_start <= p < r.bin_end for p, s in finite)
        step = r.bin_end - r.bin_start
        lead = step / 10 ** math.floor(math.log10(step) + 1e-9)
        assert min(abs(lead - k) for k in (1, 2, 5, 10)) < 1e-6
        assert abs(r.bin_start / step - round(r.bin_start / step)) < 1e-6
        assert 20 / math.sqrt(10) < (hi - lo) / step < 20 * math.sqrt(10)
    if lo < hi:
        assert min(r.bin_number for r in got) == 0


def test_sql_functions_see_the_rows_of_their_time(spark, make_trades):
    import datetime as dt
    from ticklens.operators import windows
    from ticklens.plans import views
    rows = [(1, "2024-01-01 00:00:10", 1.0, 1.0, "buy"), (2, "2024-01-01 00:00:10", 2.0, 1.0, "buy"), (3, "2024-01-01 05:59:59", None, 2.0, "buy"),
            (4, "2024-01-01 06:00:00", 4.0, 2.0, "buy"), (5, None, 5.0, 1.0, "buy")]
    views.register_views(spark, make_trades(rows[:1]))
    assert set(views.register_functions(spark)) == {"ohlc", "vwap", "changes"}
    assert views.run_sql(spark, "SELECT * FROM vwap(NULL)").first().total_trades == 1
    t = make_trades(rows)
    views.register_views(spark, t)  # grown
    assert views.run_sql(spark, "SELECT * FROM vwap(NULL)").first().total_trades == 5
    got = {r.id: (r.prev_price, r.pct_change) for r in views.run_sql(spark, "SELECT * FROM changes(NULL)").collect()}
    assert got == {r.id: (r.prev_price, r.pct_change) for r in windows.price_changes(t).collect()}
    bar = views.run_sql(spark, "SELECT * FROM ohlc(:s, :t) WHERE timestamp IS NOT NULL ORDER BY timestamp", s=3600, t=dt.datetime(2024, 1, 1)).first()
    assert (bar.timestamp, bar.open, bar.close, bar.volume, bar.trade_count) == (dt.datetime(2024, 1, 1), 1.0, 2.0, 2.0, 2)
