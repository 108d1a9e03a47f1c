"""Cleaning by session date: a late file rewrites the dates it reaches, not the table.

A store is a folder of three Parquet tables, each with one partition for a session date: ``kept`` (ticks that passed),
``edges`` (first and last kept tick of each key and date, a row each) and ``grid`` (the regular grid). Volume caps are those of a
key's date, so a date is cleaned from its own ticks alone. Only the grid looks across dates: its points hold the last
known tick. The ticks it needs from other dates are one row per key out of ``edges``.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import interval_micros
from ..plans import Axis, TICKS
from ..plans.layout import materialise
from .clean import flag_ticks, regular_grid

DATE = "session_date"
DAY_MICROS = 86_400_000_000


def _replace(df: DataFrame, path: str, first: date, last: date, *within: str) -> DataFrame:
    """Make ``df`` the partitions of ``path`` from ``first`` to ``last``; dates it has no row of lose theirs. Gives the table back.

    Ranges of the date and of ``within`` are tasks of the write, so that a large date takes several.
    """
    spark = df.sparkSession
    rows = materialise(df)
    asked = {str(first + timedelta(days=k)) for k in range((last - first).days + 1)}
    has = {r[0] for r in rows.select(DATE).distinct().collect()}
    rows.repartitionByRange(DATE, *within).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        column, _, value = status.getPath().getName().partition("=")
        if column == DATE and value in asked and date.fromisoformat(value) not in has:
            files.delete(status.getPath(), True)
    return stored(spark, path, df.schema)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of a store, its date last as partitioned reads give it."""
    fields = [f for f in schema if f.name != DATE] + [T.StructField(DATE, T.DateType())]
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in fields])).parquet(path)


def _span(edges: DataFrame, touched: DataFrame, keys: tuple[str, ...], first: date, last: date) -> tuple[date, date]:
    """From the last date before ``first`` to the first one after ``last`` on which a touched key has kept ticks."""
    near = edges.join(F.broadcast(touched) if touched.count() <= 500_000 else touched, list(keys), "left_semi")
    near = near.groupBy(*keys).agg(
        F.max(F.when(F.col(DATE) < F.lit(first), F.col(DATE))).alias("before"), F.min(F.when(F.col(DATE) > F.lit(last), F.col(DATE))).alias("after")
    )
    low, high = near.agg(F.min("before"), F.max("after")).first()
    return min(first, low or first), max(last, high or last)


def clean_dates(
    raw: DataFrame, store: str, first: date, last: date, axis: Axis = TICKS, step: str = "1 second",
    volume_sigmas: float = 5.0, price: str = "price", volume: str = "volume",
) -> tuple[date, date]:
    """Clean the dates from ``first`` to ``last`` of ``raw`` into ``store`` and say which dates of the grid were written.

    The result is that of one call over all dates, in whatever order and however often dates are cleaned. ``raw`` has a
    ``session_date``, best as its partition column, so that other dates are not read. Grid dates on either side are written again as far as
    the next kept tick of a key in ``raw``, because their points may hold a tick that changed. A missing price is removed with the
    bad ones. Rows without a date are left out; a date without kept ticks has no partition in ``kept``. ``step`` must divide a day.
    A run that was cut short is repeated whole: every table is replaced by date. One call at a time may write a store.
    """
    us = interval_micros(step)
    if DAY_MICROS % us:
        raise ValueError("step must divide a day")
    if first > last:
        raise ValueError("first must not be after last")
    day = raw.where(F.col(DATE).between(F.lit(first), F.lit(last)))
    by_date = replace(axis, keys=(*axis.keys, DATE)).measured(day)
    flagged = flag_ticks(day, by_date, "drop", volume_sigmas, price, volume)
    kept = _replace(flagged.filter("_fair").select(*raw.columns), f"{store}/kept", first, last, axis.ts)

    values = [c for c in raw.columns if c not in (*axis.keys, DATE)]
    ends = [
        F.struct(*[pick(c, axis.ts).alias(c) for c in values]).alias(name) for name, pick in (("first_row", F.min_by), ("last_row", F.max_by))
    ]
    here = kept.where(F.col(DATE).between(F.lit(first), F.lit(last)))
    edges = _replace(here.groupBy(*axis.keys, DATE).agg(*ends), f"{store}/edges", first, last, *axis.keys)

    low, high = _span(edges, day.select(*axis.keys).distinct(), axis.keys, first, last)
    ts, kind = F.col(axis.ts), raw.schema[axis.ts].dataType
    opening = F.lit(low).cast(kind) - F.expr(f"make_dt_interval(0, 0, 0, {us / 1e6:.6f})")
    closing = F.lit(high + timedelta(days=2)).cast(kind)
    # one tick per key from either side, brought near, so that a long gap makes no points outside the span
    carried = edges.where(F.col(DATE) < F.lit(low)).groupBy(*axis.keys).agg(F.max_by("last_row", DATE).alias("row"))
    following = edges.where(F.col(DATE) > F.lit(high)).groupBy(*axis.keys).agg(F.min_by("first_row", DATE).alias("row"))
    rows = (
        kept.where(F.col(DATE).between(F.lit(low), F.lit(high))).select(*axis.keys, *values)
        .unionByName(carried.select(*axis.keys, "row.*").withColumn(axis.ts, F.greatest(ts, opening)))
        .unionByName(following.select(*axis.keys, "row.*").withColumn(axis.ts, F.least(ts, closing)))
    )
    grid = regular_grid(rows, axis, step).withColumn(DATE, F.to_date(axis.ts))
    grid = grid.where(F.col(DATE).between(F.lit(low), F.lit(high))).select(*raw.columns)
    _replace(grid, f"{store}/grid", low, high, axis.ts)
    return low, high
