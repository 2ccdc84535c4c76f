import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ticklens.schema import TRADES, TICKS  # noqa: E402
from ticklens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(cpus="*", shuffle_partitions=8, app="ticklens-tests")
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_trades(spark):
    def mk(rows):
        """rows: (id, 'YYYY-mm-dd HH:MM:SS', price, size, side[, exchange])."""
        out = []
        for r in rows:
            r = list(r) + [None] * (7 - len(r))
            i, t, p, s, side, ex, pair = r
            out.append((i, ts(t) if t else None, p, s, side, ex or "coinbase", pair or "BTC-USD"))
        return spark.createDataFrame(out, TRADES)
    return mk


@pytest.fixture
def make_ticks(spark):
    def mk(rows):
        return spark.createDataFrame([(i, p, ts(t), src, sub) for i, p, t, src, sub in rows], TICKS)
    return mk
