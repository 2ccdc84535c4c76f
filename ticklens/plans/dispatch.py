"""Parameterised entry points (P1-P5): validate, then pick an operator."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeframe import timeframe_filter, validate_stats_timeframe
from ..operators import bars, distribution, filters, stats, topk, volatility, volume, windows

# Accepted aggregation / analysis names.
PRICE_AGGREGATIONS = ("none", "second", "minute", "hour", "ohlc")
VOLUME_ANALYSES = ("by_side", "over_time", "vwap", "distribution", "large_trades")
VOLATILITY_ANALYSES = ("basic", "rolling", "by_time", "clustering", "var")


def _check_tf(timeframe) -> None:
    if not (isinstance(timeframe, (int, float)) and not isinstance(timeframe, bool) and timeframe > 0):
        raise ValueError(f"invalid timeframe: {timeframe!r}")


def trade_stats(trades: DataFrame, timeframe, as_of=None) -> DataFrame:
    """Comprehensive statistics; timeframe minutes in (0, 1440]."""
    validate_stats_timeframe(timeframe)
    return stats.comprehensive_stats(trades, timeframe, as_of)


def auto_unit(timeframe) -> str:
    """Bar unit chosen from the timeframe: <= 60 min -> second, > 60 -> minute,
    > 1440 -> hour."""
    unit = "second"
    if timeframe > 60:
        unit = "minute"
    if timeframe > 1440:
        unit = "hour"
    return unit


def price_data(trades: DataFrame, timeframe, aggregation: str = "none", as_of=None,
               unit: str | None = None) -> DataFrame:
    """Raw series ('none'), minute OHLC ('ohlc'), or averaged bars whose
    unit comes from the timeframe (or `unit=` when given)."""
    _check_tf(timeframe)
    if aggregation not in PRICE_AGGREGATIONS:
        raise ValueError(f"invalid aggregation: {aggregation!r}")
    if aggregation == "none":
        return filters.price_series(trades, timeframe, as_of)
    if aggregation == "ohlc":
        return bars.ohlc_bars(trades, "minute", timeframe, as_of)
    return bars.aggregated_price(trades, unit or auto_unit(timeframe), timeframe, as_of)


def volume_analysis(trades: DataFrame, timeframe, analysis: str = "by_side", as_of=None) -> DataFrame:
    """by_side, over_time, vwap, distribution, large_trades."""
    _check_tf(timeframe)
    fns = {
        "by_side": lambda: volume.volume_by_side(trades, timeframe, as_of),
        "over_time": lambda: bars.volume_over_time(trades, "minute", timeframe, as_of),
        "vwap": lambda: volume.vwap(trades, timeframe, as_of),
        "distribution": lambda: distribution.volume_distribution(trades, 10, timeframe, as_of),
        "large_trades": lambda: topk.large_trades(trades, 1.0, timeframe, as_of),
    }
    if analysis not in VOLUME_ANALYSES:
        raise ValueError(f"{analysis!r} is no volume analysis; use one of {', '.join(VOLUME_ANALYSES)}")
    return fns[analysis]()


def volatility_analysis(trades: DataFrame, timeframe, analysis: str = "basic", as_of=None) -> DataFrame:
    """Basic (one row), rolling, by_time (hour), clustering, var (95 %)."""
    _check_tf(timeframe)
    fns = {
        "basic": lambda: volatility.basic_volatility(trades, timeframe, as_of),
        "rolling": lambda: windows.rolling_volatility(trades, 20, timeframe, as_of),
        "by_time": lambda: volatility.volatility_by_period(trades, "hour", timeframe, as_of),
        "clustering": lambda: volatility.volatility_clustering(trades, timeframe, as_of),
        "var": lambda: volatility.value_at_risk(trades, 0.95, timeframe, as_of),
    }
    if analysis not in VOLATILITY_ANALYSES:
        raise ValueError(f"{analysis!r} is no volatility analysis; use one of {', '.join(VOLATILITY_ANALYSES)}")
    return fns[analysis]()


class Dashboard(Mapping):
    """P5's DataFrames by name, each built when it is first asked for, and the cached rows that feed
    them.  `release()`, or leaving a `with` block, frees the cache; DataFrames that were built still
    work afterwards."""

    def __init__(self, views: dict[str, Callable[[], DataFrame]], cached: Callable[[], list[DataFrame]] = list) -> None:
        self._makers, self._built, self._cached = views, {}, cached

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def release(self) -> None:
        for df in self._cached():
            df.unpersist()

    def __enter__(self) -> Dashboard:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def dashboard(trades: DataFrame, timeframe, as_of=None, persist: bool = True) -> Dashboard:
    """P5: the dashboard bundle for one timeframe: price series, volatility, distribution, moving
    averages, volume by side, share and heatmap.

    A view that isn't asked for costs nothing.  With `persist` the table is read once, for the
    timeframe's rows put in order with their previous price and moving averages by ONE ordered pass;
    all views come from those cached rows (until the bundle is released).  Without it each view is its
    operator's own plan.
    """
    _check_tf(timeframe)
    slice_ = timeframe_filter(trades, timeframe, as_of)
    if not persist:
        return Dashboard({
            "price": lambda: filters.price_series(slice_),
            "volatility": lambda: volatility.basic_volatility(slice_),
            "distribution": lambda: distribution.price_distribution(slice_, 10),
            "moving_averages": lambda: windows.moving_averages(slice_),
            "volume": lambda: volume.volume_by_side(slice_),
            "volume_share": lambda: volume.volume_share(slice_),
            "heatmap": lambda: distribution.price_time_heatmap(slice_),
        })
    kept: list[DataFrame] = []

    def rows() -> DataFrame:
        if not kept:
            kept.append(slice_.persist())
            kept.append(windows.ordered_analytics(slice_).persist())
        return kept[1]

    periods = windows.AVERAGE_PERIODS
    return Dashboard({
        "price": lambda: rows().select("timestamp", "price"),
        "volatility": lambda: volatility.volatility_of(rows().filter(F.col("prev_price").isNotNull())),
        "distribution": lambda: distribution.price_distribution(rows(), 10),
        "moving_averages": lambda: rows().select("timestamp", "id", "price", *[f"ma_{p}" for p in periods]),
        "volume": lambda: volume.volume_by_side(rows()),
        "volume_share": lambda: volume.volume_share(rows()),
        "heatmap": lambda: distribution.price_time_heatmap(rows()),
    }, lambda: kept)
