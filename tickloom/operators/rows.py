"""Row filters, buckets, clipping, sampling and top rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import col
from ..plans import Axis, TICKS, attach, quantiles


def beyond(df: DataFrame, x: str, threshold: float) -> DataFrame:
    """Rows below a negative threshold or above a positive one; missing values are dropped."""
    return df.filter(F.col(x) < threshold if threshold < 0 else F.col(x) > threshold)


def move_bucket(x: str = "ret", low: float = -0.02, high: float = 0.02) -> Column:
    """``crash`` below ``low``, ``rally`` above ``high``, else ``normal`` (also when missing)."""
    return F.when(col(x) < low, "crash").when(col(x) > high, "rally").otherwise("normal")


def move_counts(df: DataFrame, axis: Axis = TICKS, x: str = "ret", low=-0.02, high=0.02) -> DataFrame:
    """Number of crash and rally rows per key."""
    return df.groupBy(*axis.keys).agg(
        F.count_if(F.col(x) < low).alias("crashes"),
        F.count_if(F.col(x) > high).alias("rallies"),
        F.count("*").alias("rows"),
    )


def between_dates(df: DataFrame, ts: str, first: date, last: date) -> DataFrame:
    """Rows from the start of ``first`` to the end of ``last``; a plain range, so it is pushed down."""
    start = F.lit(first.isoformat()).cast(df.schema[ts].dataType)
    end = F.date_add(F.lit(last.isoformat()).cast("date"), 1).cast(df.schema[ts].dataType)
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def session_hours(df: DataFrame, ts: str = "ts", opens: str = "09:30", closes: str = "16:00") -> DataFrame:
    """Rows whose time of day lies in the session, both ends included."""

    def seconds(clock: str) -> int:
        h, m, *s = clock.split(":")
        return int(h) * 3600 + int(m) * 60 + (int(s[0]) if s else 0)

    time_of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts))
    return df.filter(time_of_day.between(seconds(opens), seconds(closes)))


def drop_incomplete(df: DataFrame, how: str = "any", subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any (or all) of the columns missing."""
    return df.na.drop(how, subset=subset)


def positive_only(df: DataFrame, x: str = "price") -> DataFrame:
    """Rows with a price above zero; a missing price goes too."""
    return df.filter(F.col(x) > 0)


def volume_within(
    df: DataFrame, axis: Axis = TICKS, x: str = "volume", sigmas: float = 5.0,
) -> DataFrame:
    """Rows with 0 < volume < mean + ``sigmas``·std, the limit being each key's own."""
    axis = axis.measured(df)
    caps = df.groupBy(*axis.keys).agg((F.avg(x) + sigmas * F.stddev_samp(x)).alias("_cap"))
    kept = attach(df, caps, axis.keys, axis.n_keys).filter((F.col(x) > 0) & (F.col(x) < F.col("_cap")))
    return kept.drop("_cap")


def share_positive(x: str | Column) -> Column:
    """Percentage of known values above zero."""
    return F.avg((col(x) > 0).cast("double")) * 100


def winsorise(df: DataFrame, axis: Axis = TICKS, x: str = "ofi", low=0.01, high=0.99, out=None) -> DataFrame:
    """Clip a column to two of its own exact quantiles, per key."""
    axis = axis.measured(df)
    limits = quantiles(df, axis, x, [low, high], name="_limits")
    clipped = F.when(
        F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_limits")[0]), F.col("_limits")[1])
    )
    return attach(df, limits, axis.keys, axis.n_keys).withColumn(out or x, clipped).drop("_limits")


def extremes(df: DataFrame, x: str, n: int = 5, worst: bool = True) -> DataFrame:
    """The ``n`` lowest or highest rows, missing values last either way."""
    c = F.col(x)
    return df.orderBy(c.asc_nulls_last() if worst else c.desc_nulls_last()).limit(n)


def first_rows(df: DataFrame, axis: Axis = TICKS, n: int = 5, last: bool = False) -> DataFrame:
    """The first (or last) ``n`` rows of the whole table in axis order."""
    order = [F.col(c).desc() if last else F.col(c).asc() for c in axis.order]
    return df.orderBy(*order).limit(n)


def ends(df: DataFrame, axis: Axis = TICKS, columns: list[str] | None = None) -> DataFrame:
    """First and last row of each key, side by side as ``first_*`` and ``last_*``."""
    columns = columns or [c for c in df.columns if c not in axis.keys]
    return df.groupBy(*axis.keys).agg(
        *[F.min_by(c, axis.at(df)).alias(f"first_{c}") for c in columns],
        *[F.max_by(c, axis.at(df)).alias(f"last_{c}") for c in columns],
    )


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both tables, columns matched by name."""
    return df.unionByName(other)


def pick(df: DataFrame, n: int, on: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in a fixed pseudo-random order of the columns ``on``."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in on])), *on).limit(n)


def align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows present in both tables with no missing value, matched on the axis columns."""
    return left.join(right, on, "inner").na.drop("any")
