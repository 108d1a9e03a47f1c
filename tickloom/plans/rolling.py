"""Bounded row frames (lag, lead, rolling) that survive a key too large for one task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .axis import POS, Axis, ordered_window
from .layout import number_rows
from .orderstat import trailing_ranks


def over_rows(
    df: DataFrame,
    axis: Axis,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    laid_out: bool = False,
) -> DataFrame:
    """Run ``build(df, window)``, whose columns look at most ``back`` rows behind and
    ``ahead`` rows in front of their own row, counted over all the steps inside it.

    ``build`` may only add or replace columns. When the largest key fits in one task the window is a plain
    per-key one. Otherwise each key is cut into runs of equal row count; the rows at the
    edges of a run are copied into its neighbour, the window runs per (key, run), and the
    copies are dropped, so the values are those of the plain window. ``laid_out`` says that ``df`` comes
    from ``lay_out`` with no row taken out since; otherwise rows are numbered anew.
    """
    axis = axis.measured(df)
    laid_out = laid_out and POS in df.columns
    if axis.fits and not laid_out:
        return build(df, axis.window())
    rows = df if laid_out else number_rows(df.drop(POS), axis)
    size = max(axis.rows_per_task, back, ahead, 1)
    home, slot = F.expr(f"{POS} div {size}L"), F.expr(f"{POS} % {size}L")
    runs = F.array_compact(
        F.array(
            home,
            F.when(slot >= size - back, home + 1),
            F.when((slot < ahead) & (home > 0), home - 1),
        )
    )
    spread = rows.withColumn("_home", home).withColumn("_run", F.explode(runs))
    built = build(spread, ordered_window((*axis.keys, "_run"), (POS,)))
    out = built.filter("_run = _home").drop("_home", "_run")
    return out if laid_out else out.drop(POS)


def before(x: str | Column, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(x, k).over(w)


def after(x: str | Column, w: WindowSpec, k: int = 1) -> Column:
    return F.lead(x, k).over(w)


def change(x: str | Column, w: WindowSpec) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x - F.lag(x, 1).over(w)


def trailing(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The last ``n`` rows up to ``skip`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def rolling(
    fn: Callable[[Column], Column],
    x: str | Column,
    w: WindowSpec,
    n: int,
    min_periods: int | None = None,
    skip: int = 0,
) -> Column:
    """``fn`` over a trailing frame, missing until ``min_periods`` (default ``n``) values are in it."""
    x = F.col(x) if isinstance(x, str) else x
    frame = trailing(w, n, skip)
    need = n if min_periods is None else min_periods
    value = fn(x).over(frame)
    return value if need <= 1 else F.when(F.count(x).over(frame) >= need, value)


def rolling_mean(x, w, n, **kw) -> Column:
    return rolling(F.avg, x, w, n, **kw)


def rolling_std(x, w, n, **kw) -> Column:
    return rolling(F.stddev_samp, x, w, n, **kw)


def rolling_sum(x, w, n, **kw) -> Column:
    return rolling(F.sum, x, w, n, **kw)


def with_rolling_sums(df: DataFrame, w: WindowSpec, **sums: tuple[str, int]) -> DataFrame:
    """Add ``name = (column, n)`` sums over trailing frames, missing until a frame is full.

    A sliding frame adds up its ``n`` rows again for every row. For whole numbers the same sum
    is the difference of two running totals, exactly, at a cost that does not depend on ``n``.
    """
    whole = {x for x, _ in sums.values() if isinstance(df.schema[x].dataType, T.IntegralType)}
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    totals = {}
    for x in whole:
        totals |= {f"_total_{x}": F.sum(x).over(upto), f"_known_{x}": F.count(x).over(upto)}

    def last(total, n):
        return F.col(total) - F.coalesce(F.lag(total, n).over(w), F.lit(0))

    added = {
        name: F.when(last(f"_known_{x}", n) >= n, last(f"_total_{x}", n)) if x in whole else rolling_sum(x, w, n)
        for name, (x, n) in sums.items()
    }
    return (df.withColumns(totals) if totals else df).withColumns(added).drop(*totals)


def full_frames(w: WindowSpec, n: int, step: int, **values: tuple[str, ...]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Columns to add one after the other: states of frames of ``step`` rows, and ``values`` over frames of ``n`` rows from them.

    A value is ``("std", x)`` or ``("slope", y, x)``, the slope of y over x, missing unless the frame holds ``n`` known values
    or pairs. A sliding frame adds up its rows again for every row; here it does so for ``step`` rows, and the states of
    ``n / step`` frames side by side merge by Chan's formula, so nothing cancels and a constant frame has no spread at all.
    """
    if n % step:
        raise ValueError("a frame is cut into whole steps")
    frame, states, found = trailing(w, step), {}, {}

    def parts(name: str, state: Column, *known: str) -> list[Column]:
        full = reduce(lambda a, b: a & b, [F.count(x).over(frame) == step for x in known])
        states.setdefault(name, F.when(full, state.over(frame)))
        return [F.lag(name, k).over(w) if k else F.col(name) for k in range(0, n, step)]

    def total(terms: list[Column]) -> Column:
        # in halves: four equal means add up exactly
        half = len(terms) // 2
        return total(terms[:half]) + total(terms[half:]) if half else terms[0]

    def spread(x: str, y: str) -> Column:
        """Sum of the products of the deviations of x and y."""
        inner = parts(f"_var_{x}", F.var_pop(x), x) if x == y else parts(f"_cov_{x}_{y}", F.covar_pop(x, y), x, y)
        mx, my = (parts(f"_mean_{c}", F.avg(c), c) for c in (x, y))
        off = lambda means: [m - total(means) / len(means) for m in means]
        return (total(inner) + total([a * b for a, b in zip(off(mx), off(my))])) * step

    for name, (kind, *columns) in values.items():
        if kind == "std":
            found[name] = F.sqrt(spread(columns[0], columns[0]) / (n - 1))
        elif kind == "slope":
            y, x = columns
            across = spread(x, x)
            found[name] = F.when(across != 0, spread(y, x) / across)
        else:
            raise ValueError(f"unknown value of a frame {kind!r}: choose std or slope")
    return states, found


def rolling_min(x, w, n, **kw) -> Column:
    return rolling(F.min, x, w, n, **kw)


def rolling_max(x, w, n, **kw) -> Column:
    return rolling(F.max, x, w, n, **kw)


def rolling_var(x, w, n, **kw) -> Column:
    return rolling(F.var_samp, x, w, n, **kw)


def rolling_cov(a: str | Column, b: str | Column, w: WindowSpec, n: int) -> Column:
    """Sample covariance of the pairs in a trailing frame, missing until it holds ``n`` whole pairs."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    frame = trailing(w, n)
    return F.when(F.count(a * b).over(frame) >= n, F.covar_samp(a, b).over(frame))


def with_rolling_ranks(df: DataFrame, w: WindowSpec, n: int, **ranks: str) -> DataFrame:
    """Add ``name = column`` tie-averaged ranks of the current value among the known ones of its last ``n`` rows, over
    their number; missing for a missing value.

    Inside each part of ``w`` (a key, or the run of a large key) values are counted through a wavelet matrix: about
    log2(rows) steps for a whole column, whatever ``n`` is.
    """
    schema = T.StructType([*[f for f in df.schema if f.name not in ranks], *[T.StructField(name, T.DoubleType()) for name in ranks]])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in w_order])
        found = {name: trailing_ranks(rows.column(x), n) for name, x in ranks.items()}
        rows = rows.drop_columns([c for c in rows.column_names if c in ranks])
        for name, values in found.items():
            rows = rows.append_column(name, values)
        return rows

    w_order = w.order  # the window itself stays on the driver
    return df.groupBy(*w.parts).applyInArrow(add, schema)


def rolling_rank(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Tie-averaged rank of the current value in its trailing frame, over the frame's own length.

    One expression, which compares the value with each of the ``n``; ``with_rolling_ranks`` does not.
    """
    x = F.col(x) if isinstance(x, str) else x
    seen = F.collect_list(x).over(trailing(w, n))
    less = F.size(F.filter(seen, lambda v: v < x))
    ties = F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull(), (less + (ties + 1) / 2) / F.size(seen))
