"""Descriptions, tests and correlations, each grouped by key: aggregates first, then a
closed form on the one row per group that is left."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    chi2_two_df_tail, normal_density, normality_k2, ratio, round_to, student_p,
)
from ..plans import Axis, TICKS, attach, average_rank, before, over_rows, quantiles, rank_correlations


def return_summary(df: DataFrame, axis: Axis = TICKS, ret: str = "ret") -> DataFrame:
    """Best, worst and mean return, population variance and std, and win rate."""
    return df.groupBy(*axis.keys).agg(
        F.max(ret).alias("best"),
        F.min(ret).alias("worst"),
        F.avg(ret).alias("mean"),
        F.var_pop(ret).alias("variance"),
        F.stddev_pop(ret).alias("std"),
        (F.avg((F.col(ret) > 0).cast("double")) * 100).alias("win_rate"),
    )


def moments(df: DataFrame, axis: Axis = TICKS, x: str = "ret") -> DataFrame:
    """Count, range, mean, sample variance and std, biased skewness and excess kurtosis."""
    return df.groupBy(*axis.keys).agg(
        F.count(x).alias("nobs"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
    )


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name="column", value="x") -> DataFrame:
    """One row per (row, column) with the value as a double."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, columns, name, value
    )


def describe_table(df: DataFrame, columns: list[str], axis: Axis = TICKS) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of each column, per key."""
    axis = axis.measured(df)
    long = unpivot(df, list(axis.keys), columns)
    fine = axis.by("column", groups=len(columns))
    base = long.groupBy(*fine.keys).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quarters = quantiles(long, fine, "x", [0.25, 0.5, 0.75])
    return attach(base, quarters, fine.keys, fine.n_keys).select(
        *fine.keys, "count", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column and in total, in one pass."""
    columns = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.withColumn("total_missing", sum((F.col(c) for c in columns), F.lit(0)))


def shape(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    names = F.array(*map(F.lit, df.columns))
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.array_join(names, ",").alias("names")
    )


def spacing_counts(df: DataFrame, axis: Axis = TICKS, n: int | None = 5) -> DataFrame:
    """The most frequent gaps between successive rows in microseconds (shorter gap first on a tie)."""
    gap = lambda d, w: d.withColumn(
        "gap_us", F.timestamp_diff("MICROSECOND", F.lag(axis.ts, 1).over(w), axis.ts)
    )
    counts = (
        over_rows(df.select(*axis.keys, *axis.order), axis, gap, back=1)
        .filter("gap_us IS NOT NULL").groupBy("gap_us").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "gap_us")
    )
    return counts if n is None else counts.limit(n)


def histogram(df: DataFrame, axis: Axis = TICKS, x: str = "ret", bins: int = 50, density: bool = True) -> DataFrame:
    """Counts (and density) of equal bins over each key's own range; empty bins are kept."""
    axis = axis.measured(df)
    known = df.filter(F.col(x).isNotNull()).select(*axis.keys, F.col(x).cast("double").alias("_x"))
    range_ = known.groupBy(*axis.keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n"))
    # a single value gets a unit-wide range around it
    half = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(0.0)
    range_ = range_.select(
        *axis.keys, "_n", (F.col("_lo") - half).alias("_lo"), ((F.col("_hi") + half - (F.col("_lo") - half)) / bins).alias("_w")
    )
    slot = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = (
        attach(known, range_, axis.keys, axis.n_keys)
        .groupBy(*axis.keys, slot.alias("bin")).agg(F.count("*").alias("_c"))
    )
    edges = range_.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = edges.join(counts, [*axis.keys, "bin"], "left").withColumn("count", F.coalesce("_c", F.lit(0)))
    out = full.withColumn("left_edge", F.col("_lo") + F.col("bin") * F.col("_w"))
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * F.col("_w")))
    return out.drop("_c", "_lo", "_w", "_n")


def normal_curve(df: DataFrame, axis: Axis = TICKS, x: str = "ret", points: int = 100) -> DataFrame:
    """The normal density with each key's mean and sample std, on even points over its range."""
    fit = df.groupBy(*axis.keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s")
    )
    spot = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / (points - 1)
    return (
        fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", spot)
        .withColumn("density", normal_density("x", "_m", "_s"))
        .drop("_lo", "_hi", "_m", "_s")
    )


def pair_table(df: DataFrame, left: str, right: str, on: str = "date", key: str = "symbol", value: str = "close") -> DataFrame:
    """A long table of two keys as one row per date with a column for each; dates of either are kept."""
    return (
        df.filter(F.col(key).isin(left, right)).groupBy(on).agg(
            F.max(F.when(F.col(key) == left, F.col(value))).alias("left"),
            F.max(F.when(F.col(key) == right, F.col(value))).alias("right"),
        )
    )


def correlation(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of two columns over the rows where both are known."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.corr(x, y).alias("corr"), F.count("*").alias("n")
    )


def t_test(df: DataFrame, axis: Axis = TICKS, x: str = "ret", mean: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """One-sample t-test per key: t, two-sided p and the verdict at ``alpha``."""
    agg = df.groupBy(*axis.keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s"), F.count(x).alias("n"))
    t = ratio(F.col("mean") - mean, F.col("_s") / F.sqrt(F.col("n").cast("double")))
    return (
        agg.withColumn("t_stat", t)
        .withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 1).cast("double")))
        .withColumn("reject", F.col("p_value") < alpha)
        .drop("_s")
    )


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Number of tests, of raw rejections, the corrected threshold and rejections under it."""
    counted = tests.agg(F.count("*").alias("n_tests"))
    return tests.withColumn("n_tests", counted.scalar()).agg(
        F.max("n_tests").alias("n_tests"),
        F.count_if(F.col("p_value") < alpha).alias("significant_before"),
        F.max(F.lit(alpha) / F.col("n_tests")).alias("threshold"),
        F.count_if(F.col("p_value") < F.lit(alpha) / F.col("n_tests")).alias("significant_after"),
    )


def normality(df: DataFrame, axis: Axis = TICKS, x: str = "ret") -> DataFrame:
    """D'Agostino–Pearson K² and its p-value per key."""
    agg = df.groupBy(*axis.keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    return agg.withColumn("k2", normality_k2("n", "skewness", "kurtosis")).withColumn("p_value", chi2_two_df_tail("k2"))


def ols(df: DataFrame, y: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """y = a + b·x per key: coefficients, R², standard error, t and p of the slope."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = pairs.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.count("*").alias("n"),
    )
    noise = ratio(F.col("_syy") - ratio(F.col("_sxy") * F.col("_sxy"), "_sxx"), F.col("n") - 2)
    return (
        agg.withColumn("std_err", F.sqrt(ratio(noise, "_sxx")))
        .withColumn("t_stat", ratio("beta", "std_err"))
        .withColumn("p_value", student_p(F.col("t_stat"), (F.col("n") - 2).cast("double")))
        .drop("_sxx", "_syy", "_sxy")
    )


def ols_residuals(df: DataFrame, fit: DataFrame, y: str, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Skewness, kurtosis and Jarque–Bera statistic of the residuals of ``ols``."""
    coefficients = fit.select(*keys, "beta", "intercept")
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if keys:
        joined = pairs.join(coefficients, list(keys))
    else:
        only = coefficients.select(F.struct("beta", "intercept")).scalar()
        joined = pairs.withColumn("_fit", only).select("*", "_fit.*")
    agg = joined.withColumn("_e", F.col(y) - F.col("intercept") - F.col("beta") * F.col(x)).groupBy(*keys).agg(
        F.count("_e").alias("n"), F.skewness("_e").alias("skewness"), (F.kurtosis("_e") + 3).alias("kurtosis")
    )
    s, k = F.col("skewness"), F.col("kurtosis") - 3
    return agg.withColumn("jarque_bera", F.col("n") / 6 * (s * s + k * k / 4)).withColumn(
        "jb_p_value", chi2_two_df_tail("jarque_bera")
    )


def autocorrelation(df: DataFrame, axis: Axis = TICKS, x: str = "ofi", max_lag: int = 20) -> DataFrame:
    """Autocorrelation to ``max_lag`` with ±1.96/√n bands, one row per (key, lag).

    The products of a value with each of its lags are averaged over the pairs there are and
    divided by the sample variance; a constant series gives 0 and lag 0 is 1.
    """
    axis = axis.measured(df)
    known = df.filter(F.col(x).isNotNull()).select(*axis.keys, *axis.order, F.col(x).cast("double").alias("_x"))
    means = known.groupBy(*axis.keys).agg(F.avg("_x").alias("_m"))
    centred = attach(known, means, axis.keys, axis.n_keys).withColumn("_c", F.col("_x") - F.col("_m"))

    def products(d, w):
        return d.withColumns({f"_k{k}": F.col("_c") * before("_c", w, k) for k in range(1, max_lag + 1)})

    agg = over_rows(centred, axis, products, back=max_lag).groupBy(*axis.keys).agg(
        F.count("*").alias("n"), F.var_samp("_c").alias("_var"),
        *[F.avg(f"_k{k}").alias(f"_k{k}") for k in range(1, max_lag + 1)],
    )
    lags = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))] + [
        F.struct(
            F.lit(k).alias("lag"),
            F.when(F.col(f"_k{k}").isNotNull(), F.when(F.col("_var") > 0, ratio(f"_k{k}", "_var")).otherwise(0.0)).alias("acf"),
        )
        for k in range(1, max_lag + 1)
    ]
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    return agg.select(
        *axis.keys, F.explode(F.array(*lags)).alias("_l"), band.alias("conf_upper"), (-band).alias("conf_lower")
    ).select(*axis.keys, "_l.*", "conf_upper", "conf_lower")


def significant_lags(acf: DataFrame) -> DataFrame:
    """Lags above 0 whose autocorrelation lies outside the bands."""
    return acf.filter((F.abs("acf") > F.col("conf_upper")) & (F.col("lag") > 0))


def rank_ic(
    df: DataFrame, axis: Axis = TICKS, signal: str = "ofi_lag1", target: str = "forward_return",
    min_obs: int = 0, round_dp: tuple[int, int, int] | None = None, alpha: float = 0.05,
) -> DataFrame:
    """Spearman correlation of a signal with a return per key, after dropping incomplete pairs.

    Keys with fewer than ``min_obs`` pairs are left out. ``round_dp`` rounds IC, t and p.
    """
    axis = axis.measured(df)
    pairs = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull()).select(
        *axis.keys, *_places(df, axis), F.col(signal).alias("_x"), F.col(target).alias("_y")
    )
    ranked = average_rank(pairs, axis, _rx="_x", _ry="_y")
    agg = ranked.groupBy(*axis.keys).agg(F.corr("_rx", "_ry").alias("ic"), F.count("*").alias("n_obs"))
    agg = agg.filter(F.col("n_obs") >= min_obs)
    ic, n = F.col("ic"), F.col("n_obs").cast("double")
    # the reported t has a small constant in its denominator; the p-value uses the plain one
    exact_t = F.when(F.abs(ic) >= 1, F.signum(ic) * F.lit(math.inf)).otherwise(ic * F.sqrt((n - 2) / (1 - ic * ic)))
    dp = round_dp or (None, None, None)
    return (
        agg.withColumn("t_stat", ic * F.sqrt(n - 2) / F.sqrt(1 - ic * ic + 1e-10))
        .withColumn("p_value", student_p(exact_t, n - 2))
        .withColumn("significant", F.col("p_value") < alpha)
        .withColumns({c: round_to(F.col(c), d) for c, d in zip(("ic", "t_stat", "p_value"), dp)})
    )


def _places(df: DataFrame, axis: Axis) -> list[str]:
    """The order columns, which only a key too large for one task needs for its ranks."""
    return [] if axis.fits else [c for c in axis.order if c in df.columns]


def feature_ic(
    df: DataFrame, features: list[str], axis: Axis = TICKS, target: str = "ret_1m", round_dp: int | None = None, stored: bool = False,
) -> DataFrame:
    """Spearman correlation of every feature with one target over the rows complete in all of them.

    ``stored`` says that ``df`` is read from a table with little work, so that its rows need not be written once more.
    """
    axis = axis.measured(df)
    places = [c for c in axis.order if c in df.columns and c not in (*features, target)]
    whole = df.select(*axis.keys, *places, *features, target).na.drop("any", subset=[*axis.keys, *features, target])
    found = rank_correlations(whole, axis, list(features), target, "feature", "ic", "n_obs", stored)
    return found.withColumn("ic", round_to(F.col("ic"), round_dp)).orderBy(*axis.keys, F.desc("ic"))
