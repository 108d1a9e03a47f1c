"""Running values from the first row of a key (sum, product, min, max, last known value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .axis import POS, Axis
from .layout import number_rows

_WHOLE = {
    "sum": F.sum,
    "product": F.product,
    "min": F.min,
    "max": F.max,
}


def _aggregate(kind: str, x: Column, at: Column, frame=None) -> Column:
    if kind != "last":
        agg = _WHOLE[kind](x)
        return agg if frame is None else agg.over(frame)
    if frame is None:
        return F.max_by(x, F.when(x.isNotNull(), at))
    return F.last(x, ignorenulls=True).over(frame)


def running(df: DataFrame, axis: Axis, *, laid_out: bool = False, **specs: tuple[str, Column | str]) -> DataFrame:
    """Add ``name = (kind, value)`` columns accumulated over all rows up to the current one.

    ``kind`` is ``sum``, ``product``, ``min``, ``max`` or ``last`` (last known value). Missing
    values are skipped. A key that fits in one task uses a plain cumulative window. A larger
    one is done in two passes: totals of each run of rows and a small window over those totals,
    then a running value inside each run that starts from what the earlier runs left. ``laid_out`` says that ``df``
    comes from ``lay_out`` with no row taken out since; otherwise rows are numbered anew.
    """
    axis = axis.measured(df)
    laid_out = laid_out and POS in df.columns
    values = {f"_in_{n}": F.col(v) if isinstance(v, str) else v for n, (_, v) in specs.items()}
    if axis.fits and not laid_out:
        upto = axis.window().rowsBetween(W.unboundedPreceding, 0)
        added = {n: _aggregate(kind, F.col(f"_in_{n}"), F.lit(0), upto) for n, (kind, _) in specs.items()}
        return df.withColumns(values).withColumns(added).drop(*values)

    rows = (df if laid_out else number_rows(df.drop(POS), axis)).withColumns(values)
    rows = rows.withColumn("_run", F.expr(f"{POS} div {axis.rows_per_task}L"))
    totals = rows.groupBy(*axis.keys, "_run").agg(
        *[_aggregate(kind, F.col(f"_in_{n}"), F.col(POS)).alias(f"_in_{n}") for n, (kind, _) in specs.items()]
    )
    earlier = W.partitionBy(*axis.keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    # what the earlier runs left enters each run as one more row, ahead of its first
    carried = totals.select(
        *axis.keys, "_run", F.lit(-1).cast("bigint").alias(POS),
        *[_aggregate(kind, F.col(f"_in_{n}"), F.lit(0), earlier).alias(f"_in_{n}") for n, (kind, _) in specs.items()],
    )
    upto = W.partitionBy(*axis.keys, "_run").orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    out = (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumns({n: _aggregate(kind, F.col(f"_in_{n}"), F.lit(0), upto) for n, (kind, _) in specs.items()})
        .filter(F.col(POS) >= 0)
        .drop("_run", *values)
    )
    return out if laid_out else out.drop(POS)
