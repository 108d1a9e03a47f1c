"""Ridge and unit-root regressions per key.

Both need the cross-products of a wide design, and what is solved is one small matrix per key. For a ridge fit each task
adds them up for the rows it has and emits one matrix per key, summed by a shuffle on (key, cell). A unit-root design is
made of lags of one series, so its matrix follows from a band of lagged products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unit_root_p
from ..plans import (
    POS, Axis, TICKS, attach, average_rank, before, change, materialise, over_rows, rank_correlations, with_positions,
)
from .features import chronological_split

#: Matrices a task holds before it emits them.
HELD_MATRICES = 256


def cross_products(df: DataFrame, keys: tuple[str, ...], row: str) -> DataFrame:
    """X'X of the array column ``row`` per key, as (keys, cell, value) with ``cell`` row-major.

    All arrays of one key must have the same length.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("_m", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}

        def emit():
            table = pd.DataFrame(list(held), columns=list(keys))
            table["_m"] = [m.ravel().tolist() for m in held.values()]
            held.clear()
            return table

        for batch in batches:
            for key, part in batch.groupby(list(keys), sort=False, dropna=False):
                x = np.array(part[row].tolist(), dtype=float)
                held[key] = held.get(key, 0.0) + x.T @ x
                if len(held) >= HELD_MATRICES:
                    yield emit()
        if held:
            yield emit()

    return (
        df.select(*keys, row).mapInPandas(partial, schema)
        .select(*keys, F.posexplode("_m").alias("cell", "value"))
        .groupBy(*keys, "cell").agg(F.sum("value").alias("value"))
    )


def ridge_fit(df: DataFrame, features: list[str], target: str, axis: Axis = TICKS, alpha: float = 1.0) -> DataFrame:
    """Ridge coefficients (intercept not penalised) per key: ``intercept`` and an array ``coef``."""
    axis = axis.measured(df)
    p = len(features)
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double"))
    cells = cross_products(df.select(*axis.keys, row.alias("_row")), axis.keys, "_row")
    fields = [df.schema[k] for k in axis.keys]
    schema = T.StructType(
        [*fields, T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
    )

    def solve(key, cells):
        g = cells.sort_values("cell")["value"].to_numpy().reshape(p + 2, p + 2)
        n, sums = g[0, 0], g[0, 1:]
        centred = g[1:, 1:] - np.outer(sums, sums) / max(n, 1)
        coef = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])
        intercept = (sums[p] - sums[:p] @ coef) / n
        return pd.DataFrame([[*key, float(intercept), coef.tolist()]], columns=[f.name for f in schema])

    return cells.groupBy(*axis.keys).applyInPandas(solve, schema)


def _split_and_centred(df: DataFrame, columns: list[str], axis: Axis, train: float) -> DataFrame:
    """``is_train`` and each column less its mean over the key."""
    if axis.fits:
        every = axis.window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        first = F.row_number().over(axis.window()) <= F.floor(F.lit(train) * F.count("*").over(every))
        return df.withColumns({"is_train": first, **{c: F.col(c) - F.avg(c).over(every) for c in columns}})
    means = df.groupBy(*axis.keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    split = attach(chronological_split(df, axis, train), means, axis.keys, axis.n_keys)
    return split.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).drop(*[f"_m_{c}" for c in columns])


def ridge_baseline(
    df: DataFrame, features: list[str], axis: Axis = TICKS, target: str = "ret_1m", train: float = 0.7, alpha: float = 1.0,
    stored: bool = False,
) -> DataFrame:
    """Fit on the first rows of each key, scaled by their mean and population std; report rank IC and R² on the rest.

    One matrix of sums and products per (key, split), added up in the tasks, holds all that scaling, fit and R² need; a second pass over the
    test rows gives the rank IC. A key too short to be fitted or scored stays in the report with missing scores. ``stored`` says
    that ``df`` is read from a table with little work, so that its rows need not be written once more.
    """
    axis = axis.measured(df)
    columns, keys, p = [*features, target], list(axis.keys), len(features)
    whole = df.select(*keys, *axis.order, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")
    # both passes read these rows: written once, they carry no plan of how the features were made
    d = _split_and_centred(whole if stored else materialise(whole), columns, axis, train)
    row = F.array(F.lit(1.0), *columns).alias("_row")
    moments = cross_products(d.select(*keys, "is_train", row), (*keys, "is_train"), "_row")
    fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        [
            *fields, T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("oos_r2", T.DoubleType()), T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
        ]
    )

    def solve(key, parts):
        sides = {}
        for side, cells in parts.groupby("is_train"):
            g = cells.sort_values("cell")["value"].to_numpy().reshape(p + 2, p + 2)
            sides[bool(side)] = int(round(g[0, 0])), g[0, 1:], g[1:, 1:]
        blank = (0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
        (n, sums, g), (n_test, test, gt) = sides.get(True, blank), sides.get(False, blank)
        if not n:
            return pd.DataFrame([[*key, None, None, None, 0, n_test]], columns=schema.names)
        mean = sums / n
        centred = g - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(centred)[:p] / n, 0))
        # what is left of a constant column is rounding
        scale[scale <= 1e-12 * np.sqrt(np.maximum(np.diag(g)[:p] / n, 1e-300))] = 0
        scale[scale == 0] = 1
        w = np.linalg.solve(centred[:p, :p] / np.outer(scale, scale) + alpha * np.eye(p), centred[:p, p] / scale) / scale
        intercept = mean[p] - w @ mean[:p]
        r2 = None
        if n_test:
            row = np.append(-w, 1.0)
            sse = row @ gt @ row - 2 * intercept * (row @ test) + n_test * intercept**2
            sst = gt[p, p] - test[p] ** 2 / n_test
            r2 = float(1 - sse / sst) if sst > 1e-14 * max(gt[p, p], 1e-300) else None
        return pd.DataFrame([[*key, float(intercept), w.tolist(), r2, n, n_test]], columns=schema.names)

    fit, test = moments.groupBy(*keys).applyInPandas(solve, schema), d.filter("NOT is_train")
    guess = sum((F.col(c) * F.col("coef")[i] for i, c in enumerate(features)), F.col("intercept"))
    scores = ["oos_r2", "n_train", "n_test"]
    if axis.fits:
        # rows stay where they are, each key meets its fit there, and a key without test rows comes along
        met = fit.join(test, keys, "left").withColumn("prediction", guess)
        ranked = average_rank(met.select(*keys, *scores, "prediction", target), axis, _rx="prediction", _ry=target)
        return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("oos_ic"), *[F.first(c).alias(c) for c in scores])
    fit = materialise(fit)
    met = attach(test, fit.select(*keys, "intercept", "coef"), axis.keys, axis.n_keys).withColumn("prediction", guess)
    scored = met.select(*keys, *axis.order, "prediction", target).na.drop("any", subset=["prediction", target])
    ic = rank_correlations(scored, axis, ["prediction"], target, value="oos_ic").select(*keys, "oos_ic")
    return fit.join(ic, keys, "left").select(*keys, "oos_ic", *scores)


def _longest_lag(n: int) -> int:
    return max(min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25)), 0)


def lagged_products(df: DataFrame, axis: Axis, x: str, lags: int) -> DataFrame:
    """Sums over a key's series of which every regression of the change of ``x`` on its level and changes is made.

    One row per key: ``n``, ``sx`` and ``sxx`` (sums of x and x²), ``xd0`` (x one row before times the change),
    ``dd[k]`` (change times the change k rows before, k = 0..lags), ``xd[k]`` (x times the change k rows before) and the
    first and last ``lags + 2`` values, ``head`` and ``tail``. ``x`` must be known in every row. Lags look back over
    a bounded frame, so a large key is cut into runs, and all sums combine before the shuffle.
    """
    axis = axis.measured(df)
    split = not axis.fits
    d = with_positions(df.select(*axis.keys, *axis.order, F.col(x).cast("double").alias("_x")), axis)
    d = attach(d, d.groupBy(*axis.keys).agg(F.count("*").alias("_n")), axis.keys, axis.n_keys)

    def build(t, w):
        t = t.withColumns({"_before": before("_x", w), "_d": change("_x", w)})
        return t.withColumns({f"_d{k}": before("_d", w, k) for k in range(1, lags + 1)})

    d = over_rows(d, axis, build, back=lags + 1, laid_out=split)
    ks = range(lags + 1)
    d_at = lambda k: F.col(f"_d{k}") if k else F.col("_d")
    edge = lambda near: F.sort_array(F.collect_list(F.when(near, F.struct(POS, "_x"))))["_x"]
    sums = {f"_dd{k}": F.sum(F.col("_d") * d_at(k)) for k in ks} | {f"_xd{k}": F.sum(F.col("_x") * d_at(k)) for k in ks}
    found = d.groupBy(*axis.keys).agg(
        F.count("*").alias("n"), F.sum("_x").alias("sx"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(F.col("_before") * F.col("_d")).alias("xd0"),
        edge(F.col(POS) < lags + 2).alias("head"), edge(F.col(POS) >= F.col("_n") - lags - 2).alias("tail"), *[v.alias(name) for name, v in sums.items()],
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return found.select(
        *axis.keys, "n", "sx", "sxx", zero("xd0").alias("xd0"), "head", "tail",
        F.array(*[zero(f"_dd{k}") for k in ks]).alias("dd"), F.array(*[zero(f"_xd{k}") for k in ks]).alias("xd"),
    )


def gram_of_lags(n: int, sx: float, sxx: float, xd0: float, dd, xd, head, tail, lags: int) -> np.ndarray:
    """Gram matrix of (1, level before, ``lags`` earlier changes, change) over all rows that have them.

    The sums run over whole series; rows ahead of the sample and the ends that lags cut off are taken out with the first
    and last values. Along a diagonal an entry follows from the one before: its sum moves by one row, so one product
    enters at the head and one leaves at the tail.
    """
    h, t = np.asarray(head, float), np.asarray(tail, float)
    dh = np.concatenate(([0.0], np.diff(h)))  # change by row, from the start
    dt = np.concatenate(([0.0], np.diff(t)))[::-1]  # change by row, from the end
    g = np.zeros((lags + 3, lags + 3))
    place = [lags + 2, *range(2, lags + 2)]  # columns of the changes 0, 1, ..., lags rows back
    g[0, 0] = n - 1 - lags
    g[0, 1] = sx - h[:lags].sum() - t[-1]
    g[1, 1] = sxx - (h[:lags] ** 2).sum() - t[-1] ** 2
    for i, c in enumerate(place):
        g[0, c] = t[-1 - i] - h[lags - i]
    g[1, place[0]] = xd0 - (h[:lags] * dh[1 : lags + 1]).sum()
    for j in range(1, lags + 1):
        m = j - 1
        g[1, place[j]] = xd[m] - (h[j:lags] * dh[1 : lags - m]).sum() - t[-1] * dt[m]
    moves = np.zeros((lags + 1, lags + 1))
    moves[0] = [dd[k] - (dh[k + 1 : lags + 1] * dh[1 : lags + 1 - k]).sum() for k in range(lags + 1)]
    for i in range(lags):
        moves[i + 1, i + 1 :] = moves[i, i:lags] + dh[lags - i] * dh[lags - np.arange(i, lags)] - dt[i] * dt[i:lags]
    for i, c in enumerate(place):
        for j in range(i, lags + 1):
            g[c, place[j]] = moves[i, j]
    upper = np.triu(g) + np.tril(g, -1).T
    return upper + np.triu(upper, 1).T


def nested_residuals(g: np.ndarray, first: int) -> np.ndarray:
    """Residual sums of squares of the regressions on the first ``first``, ``first + 1``, ... columns of a Gram matrix.

    One Cholesky factor holds them all: each column takes its own square from what is left. Columns are scaled to length
    one, and one that hangs together with those before it takes nothing.
    """
    p = len(g) - 1
    size = np.sqrt(np.maximum(np.diag(g), 0))
    size[size == 0] = 1
    g = g / np.outer(size, size)
    low, left, out = np.zeros((p, p + 1)), g[p, p], []
    for j in range(p):
        row = g[j] - low[:j, j] @ low[:j]
        low[j] = row / math.sqrt(row[j]) if row[j] > 1e-13 else 0
        left -= low[j, p] ** 2
        if j + 1 >= first:
            out.append(max(left, 0.0) * size[p] ** 2)
    return np.array(out)


def _regress(g: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray, int]:
    """Residual sum of squares, n, coefficients, inverse and number of regressors of a Gram matrix whose last column is explained."""
    inverse = np.linalg.pinv(g[:-1, :-1])
    beta = inverse @ g[:-1, -1]
    return max(g[-1, -1] - beta @ g[:-1, -1], 0.0), g[0, 0], beta, inverse, len(g) - 1


def unit_root(
    df: DataFrame, axis: Axis = TICKS, x: str = "ofi", max_lag: int | None = None, autolag: bool = True, alpha: float = 0.05,
) -> DataFrame:
    """Augmented Dickey–Fuller test with a constant, per key; lags chosen by AIC.

    All lag counts are compared on the rows that have the most lags, then the chosen one is
    refitted on every row it can use. A constant or too short series gives missing results. What is regressed per key is
    one row of lagged products, so no row carries an array and Python sees one row per key.
    """
    axis = axis.measured(df)
    series = df.filter(F.col(x).isNotNull()).select(*axis.keys, *axis.order, F.col(x).cast("double").alias("_x"))
    top = _longest_lag(axis.widest) if max_lag is None else max_lag
    means = series.groupBy(*axis.keys).agg(F.avg("_x").alias("_m"))
    centred = attach(series, means, axis.keys, axis.n_keys).withColumn("_x", F.col("_x") - F.col("_m")).drop("_m")
    # a finer axis is written once where keys are split: it is read for counting, numbering and adding up
    ready = lagged_products(centred if axis.fits else materialise(centred), axis, "_x", top)

    result = T.StructType(
        [T.StructField("adf_stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()), T.StructField("n_lags", T.IntegerType())]
    )

    def test(n, sx, sxx, xd0, dd, xd, head, tail):
        most = max(min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25) if max_lag is None else max_lag), 0)
        if n < most + 2:
            return None, None, None
        gram = lambda lags: gram_of_lags(n, sx, sxx, xd0, dd, xd, head, tail, lags)
        g = gram(most)
        if g[1, 1] <= 1e-300 or g[-1, -1] <= 1e-300:
            return None, None, None
        lag = most
        if autolag:
            aic = [(g[0, 0] * math.log(max(ssr, 1e-300)) + 2 * (2 + k), k) for k, ssr in enumerate(nested_residuals(g, 2))]
            lag = min(aic)[1]
        ssr, rows, beta, inverse, k = _regress(g if lag == most else gram(lag))
        spread = ssr / (rows - k) * inverse[1, 1] if rows > k else 0.0
        stat = beta[1] / math.sqrt(spread) if spread > 0 else math.nan
        return (stat, unit_root_p(stat), lag) if math.isfinite(stat) else (None, None, None)

    columns = ("n", "sx", "sxx", "xd0", "dd", "xd", "head", "tail")

    @F.pandas_udf(result)
    def finish(n: pd.Series, sx: pd.Series, sxx: pd.Series, xd0: pd.Series, dd: pd.Series, xd: pd.Series, head: pd.Series, tail: pd.Series) -> pd.DataFrame:
        out = [test(*row) for row in zip(n, sx, sxx, xd0, dd, xd, head, tail)]
        return pd.DataFrame(out, columns=["adf_stat", "p_value", "n_lags"]).astype({"n_lags": "Int32"})

    return (
        ready.withColumn("_r", finish(*columns))
        .select(*axis.keys, "_r.*")
        .withColumn("stationary", F.col("p_value") < alpha)
    )
