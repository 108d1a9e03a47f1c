"""Registry of runnable queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import Axis, DAILY, TICKS
from ..sources import MARKET_SQL, market_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def over(tables: str, select: str, **steps: str) -> str:
    """SQL text: the named market tables, then ``steps`` as further CTEs, then ``select``."""
    parts = {t: MARKET_SQL[t] for t in tables.split()} | steps
    return "WITH " + ",\n".join(f"{name} AS ({text.strip()})" for name, text in parts.items()) + "\n" + select


def r(expr: str, dp: int = 6) -> str:
    """Rounded SQL expression without a negative zero."""
    return f"(round({expr}, {dp}) + 0.0)"


def rounded(df: DataFrame, dp: int = 6, **special: int) -> DataFrame:
    """Round every double column for comparison across engines."""
    return df.withColumns(
        {
            f.name: F.round(f.name, special.get(f.name, dp)) + F.lit(0.0)
            for f in df.schema
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def table(spark: SparkSession, folder: str, name: str, axis: Axis | None = None) -> tuple[DataFrame, Axis]:
    """A market table with its axis, measured once for all steps of a query."""
    df = market_table(spark, folder, name)
    axis = axis or (DAILY if name == "daily" else TICKS)
    return df, axis.measured(df)


#: Window over one series, in SQL.
W = "(PARTITION BY symbol ORDER BY ts, seq)"
WD = "(PARTITION BY symbol ORDER BY date)"


def frame(n: int, skip: int = 0, by: str = "symbol", order: str = "ts, seq") -> str:
    """SQL frame of the last ``n`` rows up to ``skip`` rows before the current one."""
    end = "CURRENT ROW" if skip == 0 else f"{skip} PRECEDING"
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end})"


def full(fn: str, x: str, n: int, skip: int = 0, order: str = "ts, seq") -> str:
    """SQL rolling value that is NULL until its frame holds ``n`` values."""
    w = frame(n, skip, order=order)
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN {fn}({x}) OVER {w} END"


def student_tail(t: str, v: str) -> str:
    """Two-sided Student tail in SQL, by Simpson's rule on cos^(v-1)."""
    low = f"atan(abs({t}) / sqrt({v}))"
    steps = 20000
    return (
        f"(2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt(pi()) * (SELECT sum("
        f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
        f" * pow(cos({low} + (pi() / 2 - {low}) * i / {steps}), {v} - 1)) * (pi() / 2 - {low}) / {steps} / 3"
        f" FROM generate_series(0, {steps}) AS g(i)))"
    )
