"""Missing values and arithmetic that follow one rule everywhere: missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, where data enters."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b``, missing where ``b`` is zero."""
    return F.try_divide(col(a), col(b))


def zero_to_null(x: str | Column) -> Column:
    x = col(x)
    return F.when(x != 0, x)


def round_to(x: Column, dp: int | None) -> Column:
    """Round half to even, or leave the value alone when ``dp`` is None."""
    return x if dp is None else F.bround(x, dp)


def interval_micros(step: str) -> int:
    """Length of a fixed interval such as ``30 seconds`` or ``5 minutes`` in microseconds."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "millisecond": 1e-3, "microsecond": 1e-6}
    amount, unit = step.strip().split()
    return round(float(amount) * units[unit.rstrip("s")] * 1_000_000)


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def from_micros(us: Column) -> Column:
    """The zone-less timestamp of a count of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def bin_start(ts: str, step_us: int | Column) -> Column:
    """Left edge of the bin of ``ts``, bins being counted from midnight 1970-01-01."""
    us = micros(ts)
    step = F.lit(step_us) if isinstance(step_us, int) else step_us
    return from_micros(us - F.pmod(us, step))
