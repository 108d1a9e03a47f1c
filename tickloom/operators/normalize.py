"""Z-score, min-max and rank normalisation, over the whole sample or a trailing window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kurt_corrected, ratio, skew_corrected, zero_to_null
from ..plans import Axis, Rolling, TICKS, attach, average_rank, over_rows, with_rolling, with_rolling_ranks

METHODS = ("zscore", "minmax", "rank")


def _rolling(d: DataFrame, w, method: str, columns: list[str], n: int, suffix: str) -> DataFrame:
    if method == "rank":
        return with_rolling_ranks(d, w, n, **{c + suffix: c for c in columns})
    kinds = {"zscore": ("mean", "std"), "minmax": ("min", "max")}[method]
    d = with_rolling(d, w, **{f"_{k}_{c}": Rolling(k, c, n, need=1) for k in kinds for c in columns})
    if method == "zscore":
        out = {c: ratio(F.col(c) - F.col(f"_mean_{c}"), zero_to_null(f"_std_{c}")) for c in columns}
    else:
        out = {c: ratio(F.col(c) - F.col(f"_min_{c}"), zero_to_null(F.col(f"_max_{c}") - F.col(f"_min_{c}"))) for c in columns}
    return d.withColumns({c + suffix: v for c, v in out.items()}).drop(*[f"_{k}_{c}" for k in kinds for c in columns])


def normalize_features(
    df: DataFrame, columns: list[str], axis: Axis = TICKS, method: str = "rank", window: int | None = None,
    suffix: str = "",
) -> DataFrame:
    """Replace (or, with a suffix, add) normalised columns.

    A missing value stays missing and a zero scale gives a missing value. Ranks are tie-averaged
    positions over the number of known values.
    """
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}: choose from {', '.join(METHODS)}")
    axis = axis.measured(df)
    if window is not None:
        return over_rows(df, axis, lambda d, w: _rolling(d, w, method, columns, window, suffix), back=window - 1)
    aggs = {
        "zscore": lambda c: [F.avg(c).alias(f"_a_{c}"), F.stddev_samp(c).alias(f"_b_{c}")],
        "minmax": lambda c: [F.min(c).alias(f"_a_{c}"), (F.max(c) - F.min(c)).alias(f"_b_{c}")],
        "rank": lambda c: [F.count(c).alias(f"_b_{c}")],
    }[method]
    totals = df.groupBy(*axis.keys).agg(*[a for c in columns for a in aggs(c)])
    d = df if method != "rank" else average_rank(df, axis, **{f"_a_{c}": c for c in columns})
    d = attach(d, totals, axis.keys, axis.n_keys)
    if method == "rank":
        out = {c + suffix: ratio(f"_a_{c}", f"_b_{c}") for c in columns}
    else:
        out = {c + suffix: ratio(F.col(c) - F.col(f"_a_{c}"), f"_b_{c}") for c in columns}
    return d.withColumns(out).drop(*[f"_{s}_{c}" for s in "ab" for c in columns])


def standardise_on_train(
    df: DataFrame, columns: list[str], axis: Axis = TICKS, is_train: str = "is_train", suffix: str = "",
) -> DataFrame:
    """Scale by the mean and population std of the training rows; a constant column is only centred."""
    axis = axis.measured(df)
    fit = df.filter(is_train).groupBy(*axis.keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = {
        c + suffix: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(zero_to_null(f"_s_{c}"), F.lit(1.0)) for c in columns
    }
    return attach(df, fit, axis.keys, axis.n_keys).withColumns(scaled).drop(*[f"_{s}_{c}" for s in "ms" for c in columns])


def normalization_audit(df: DataFrame, pairs: dict[str, tuple[str, str]], axis: Axis = TICKS) -> DataFrame:
    """Mean, std, min, max, corrected skew and kurtosis and missing count, before and after."""
    stages = [
        F.struct(F.lit(label).alias("feature"), F.lit(stage).alias("stage"), F.col(c).cast("double").alias("x"))
        for label, both in pairs.items()
        for stage, c in zip(("before", "after"), both)
    ]
    return (
        df.select(*axis.keys, F.explode(F.array(*stages)).alias("_s")).select(*axis.keys, "_s.*")
        .groupBy(*axis.keys, "feature", "stage")
        .agg(
            F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
            F.max("x").alias("max"), skew_corrected("x").alias("skew"), kurt_corrected("x").alias("kurt"),
            F.count_if(F.col("x").isNull()).alias("missing"),
        )
    )
