"""
bars are consistent, on random small trade sets."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ticklens.operators import bars, distribution
from ticklens.schema import TRADES

BASE = dt.datetime(2024, 1, 1)

trade_rows = st.lists(
    st.tuples(st.integers(0, 3600),                                   # seconds after BASE (ties likely)
              st.one_of(st.none(), st.floats(0.01, 1000, allow_nan=False)),
              st.one_of(st.none(), st.floats(0.0, 5, allow_nan=False)),
              st.sampled_from(["buy", "sell", "unknown", None])),
    min_size=1, max_size=40)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    return spark.createDataFrame(
        [(i, BASE + dt.timedelta(seconds=s), p, z, side, "x", "BTC-USD") for i, (s, p, z, side) in enumerate(rows)],
        TRADES)


def _closed_bins_brute(prices, bins):
    """The reference's loop: start = min + i*w, end = start + w, last bin closed."""
    mn, mx = min(prices), max(prices)
    w = (mx - mn) / bins
    out = []
    for i in range(bins):
        start = mn + i * w
        end = start + w
        out.append(sum(1 for p in prices if p >= start and (p <= end if i == bins - 1 else p < end)))
    return out


def _clamped_bins_brute(prices, bins):
    """min(floor((p - min) / w), n - 1); a zero range puts nothing in any bin."""
    import math
    mn, mx = min(prices), max(prices)
    w = (mx - mn) / bins
    out = [0] * bins
    if w == 0:
        return out
    for p in prices:
        out[min(math.floor((p - mn) / w), bins - 1)] += 1
    return out


@SETTINGS
@given(rows=trade_rows, bins=st.integers(1, 12))
def test_bins_match_reference_loops(spark, rows, bins):
    t = _df(spark, rows)
    prices = [p for _, p, _, _ in rows if p is not None]
    d6 = [r["count"] for r in distribution.price_distribution_closed(t, bins).collect()]
    d7 = [r["count"] for r in distribution.price_histogram(t, bins).collect()]
    if not prices:
        assert sum(d6) == 0 and sum(d7) == 0
        return
    assert d6 == _closed_bins_brute(prices, bins)
    assert d7 == _clamped_bins_brute(prices, bins)
    assert sum(d7) in (0, len(prices))          # clamped bins partition the priced rows
    half_open = sum(r.trade_count for r in distribution.volume_distribution(t, bins).collect())
    assert half_open <= len(prices)


@SETTINGS
@given(rows=trade_rows)
def test_buy_sell_other_add_up(spark, rows):
    t = _df(spark, rows)
    other = {}
    for sec, _, size, side in rows:
        minute = BASE + dt.timedelta(minutes=sec // 60)
        if size is not None and side not in ("buy", "sell"):
            other[minute] = other.get(minute, 0.0) + size
    for r in bars.volume_over_time(t, "minute").collect():
        if r.total_volume is not None:
            assert abs(r.buy_volume + r.sell_volume + other.get(r.time_bucket, 0.0) - r.total_volume) < 1e-9


def _within(lo, x, hi):
    # open / close are NULL when the first / last trade of the bar has no price
    return x is None or lo <= x <= hi


@SETTINGS
@given(rows=trade_rows)
def test_bars_are_consistent(spark, rows):
    t = _df(spark, rows)
    n = 0
    for r in bars.ohlc_bars(t, "minute").collect():
        n += r.volume
        if r.high is not None:
            assert _within(r.low, r.open, r.high) and _within(r.low, r.close, r.high)
    assert n == len(rows)
    for r in bars.ohlcv_interval_bars(t, "10s").collect():
        if r.high is not None:
            assert _within(r.low, r.open, r.high) and _within(r.low, r.close, r.high)
            assert r.low <= r.price <= r.high


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(secs=st.lists(st.integers(0, 30), min_size=1, max_size=80),        # many timestamp ties
       halo=st.integers(0, 12), bucket=st.integers(2, 60))
def test_blocked_window_equals_global_window(spark, secs, halo, bucket):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from ticklens.plans.ordered import ordered_window
    df = _df(spark, [(s, float((i * 37) % 11), 1.0, "buy") for i, s in enumerate(secs)])
    halo = max(halo, 1)                   # LAG looks back one row

    def build(w):
        return {"lag": F.lag("price").over(w),
                "s": F.sum("price").over(w.rowsBetween(-halo, 0)),
                "c": F.count(F.lit(1)).over(w.rowsBetween(-halo, 0))}

    got = {r.id: (r.lag, r.s, r.c) for r in
           ordered_window(df, ["timestamp", "id"], build, halo=halo, rows_per_bucket=bucket).collect()}
    g = Window.orderBy("timestamp", "id")
    exp = {r.id: (r.lag, r.s, r.c) for r in df.select("id", *[c.alias(k) for k, c in build(g).items()]).collect()}
    assert got == exp
