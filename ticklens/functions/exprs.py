"""Scalar column expressions used across operators (all JVM built-ins)."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_change(price, prev) -> Column:
    """(price - prev) / prev * 100; NULL when prev is NULL or zero."""
    price, prev = col_(price), col_(prev)
    return F.try_divide(price - prev, prev) * F.lit(100.0)


def frac_change(price, prev) -> Column:
    """(price - prev) / prev; NULL when prev is NULL or zero."""
    price, prev = col_(price), col_(prev)
    return F.try_divide(price - prev, prev)


def notional(price="price", size="size") -> Column:
    """price * size (notional value of a trade)."""
    return col_(price) * col_(size)


def volatility_level(abs_pct) -> Column:
    """'high' above 1.0 %, 'medium' above 0.5 %, else 'low' (NULL too)."""
    a = col_(abs_pct)
    return (F.when(a > F.lit(1.0), F.lit("high"))
             .when(a > F.lit(0.5), F.lit("medium"))
             .otherwise(F.lit("low")))


# Unit widths in microseconds for zone-free truncation.
_UNIT_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def trunc_ntz(unit: str, ts) -> Column:
    """DATE_TRUNC on a TIMESTAMP_NTZ that stays NTZ and never consults the
    session time zone (exact epoch-micro arithmetic for second..day)."""
    unit = unit.lower()
    if unit in _UNIT_MICROS:
        w = _UNIT_MICROS[unit]
        return ntz_from_micros(F.floor(epoch_micros_ntz(ts) / F.lit(w)) * F.lit(w))
    return F.date_trunc(unit, col_(ts)).cast("timestamp_ntz")


def ntz_to_instant(ts) -> Column:
    """TIMESTAMP (instant) whose UTC wall time is the given TIMESTAMP_NTZ."""
    return F.timestamp_micros(epoch_micros_ntz(ts))


def instant_to_ntz(ts) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) of a TIMESTAMP instant."""
    return ntz_from_micros(F.unix_micros(col_(ts)))


def epoch_micros_ntz(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, from its calendar
    fields only, so the session time zone (and its DST gaps) never applies."""
    c = col_(ts)
    day = F.unix_date(c.cast("date")).cast("long")
    sec = F.extract(F.lit("SECOND"), c)                       # decimal(8,6), exact
    tod = (F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60) * 1_000_000 \
        + (sec * 1_000_000).cast("long")
    return day * 86_400_000_000 + tod


def ntz_from_micros(micros) -> Column:
    """TIMESTAMP_NTZ from a (whole) microsecond count since the epoch."""
    m = col_(micros).cast("long")
    day = F.floor(m / 86_400_000_000).cast("long")
    rest = m - day * 86_400_000_000
    midnight = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", rest, midnight)


def order_key(micros: Column, tie="id") -> Column:
    """(time, id) as ONE decimal(38,0), NULL where the time is.

    A struct key cannot live in a hash-aggregate buffer, so `min_by` / `max_by`
    by one make Spark sort all rows before the partial aggregate; this key can.
    It orders as the struct does: by time, then a NULL id, then ids ascending.
    """
    place = F.coalesce(col_(tie).cast("decimal(20,0)") + F.lit(Decimal(2**63)), F.lit(Decimal(-1)))
    return (micros.cast("decimal(18,0)") * F.lit(Decimal(10**20)) + place).cast("decimal(38,0)")


def time_key(ts="timestamp", tie="id") -> Column:
    """:func:`order_key` of a TIMESTAMP_NTZ column."""
    return order_key(epoch_micros_ntz(ts), tie)


def extract_bigint(unit: str, ts) -> Column:
    """EXTRACT(unit FROM ts) as BIGINT (seconds floored, like the reference engine)."""
    return F.floor(F.extract(F.lit(unit), col_(ts))).cast("long")


def asc(*cols: str) -> list[Column]:
    """Ascending sort keys with NULLs last (the reference engine's default)."""
    return [F.col(c).asc_nulls_last() for c in cols]
