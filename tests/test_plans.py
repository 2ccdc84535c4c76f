"""Plan shape: filters reach the scan, aggregates are partial, and no plan of an
ordered operator moves all trade rows into a single partition."""
from ticklens.functions.timeframe import timeframe_filter
from ticklens.operators import bars, stats, windows
from ticklens.sources.tables import load_trades

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_timeframe_filter_pushed_to_scan(spark):
    df = timeframe_filter(load_trades(spark, SF), 1440, "2024-01-31 00:00:00").select("timestamp", "price")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in p


def test_bars_use_partial_aggregation(spark):
    p = plan(bars.ohlc_bars(load_trades(spark, SF), "minute"))
    assert "partial_min_by" in p or "partial_" in p


def test_ordered_window_has_no_single_partition_exchange(spark):
    df = windows.moving_averages(load_trades(spark, SF))
    p = plan(df)
    # the rows' one exchange deals them by bucket; nothing of theirs meets in one partition
    assert "SinglePartition" not in p and "shufflepartitionidpassthrough" in p


def test_one_pass_comprehensive_stats(spark):
    p = plan(stats.comprehensive_stats(load_trades(spark, SF), 60, "2024-01-31 00:00:00"))
    assert p.count("FileScan") == 1


def _single_partition_inputs(df) -> list[str]:
    """Operators feeding each `Exchange SinglePartition` of the executed plan."""
    import re
    df.write.format("noop").mode("overwrite").save()
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = re.sub(r"^[\s:|+\-*()0-9]*", "", lines[i + 1])
            out.append(nxt.split(" ")[0].split("(")[0])
    return out


BOUNDED = {"HashAggregate", "SortAggregate", "ObjectHashAggregate", "TakeOrderedAndProject", "GlobalLimit",
           "LocalLimit", "CollectLimit"}


def test_no_registered_plan_moves_all_rows_into_one_partition(spark):
    """SURVEY §7.6: only (partial) aggregates and top-N results may meet in
    one partition; never the trade rows themselves."""
    from ticklens.plans import registry
    offenders = {}
    for key, q in registry.queries().items():
        if key.startswith("stream_") or key in ("write_rollups", "append_trades"):
            continue                      # these run their own jobs; their inputs are checked elsewhere
        bad = [k for k in _single_partition_inputs(q(spark, SF)) if k not in BOUNDED]
        if bad:
            offenders[key] = bad
    assert offenders == {}


def test_bars_and_metrics_do_not_sort_their_rows(spark):
    """open and close come out of hash aggregates: no keyed sort aggregate over raw rows."""
    from ticklens.operators import bars
    from ticklens.sources import rollups
    from ticklens.sources.tables import load_trades
    t = load_trades(spark, SF)
    for df in (bars.ohlc_bars(t), bars.ohlcv_interval_bars(t), bars.price_history(t, as_of="2024-01-31 00:00:00"), rollups.rollups(t)):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
