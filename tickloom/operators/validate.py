"""Leakage audits and invariants, reported as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import Axis, TICKS, before, over_rows
from .features import FEATURES


def first_row_audit(model: DataFrame, features: list[str], axis: Axis = TICKS) -> DataFrame:
    """First value of each feature per key after lagging and dropping; passes when it is known."""
    firsts = model.groupBy(*axis.keys).agg(
        *[F.min_by(F.struct(F.col(c).cast("double").alias("v")), axis.at(model)).alias(c) for c in features]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}.v").alias("first_value")) for c in features]
    return firsts.select(*axis.keys, F.explode(F.array(*rows)).alias("_r")).select(*axis.keys, "_r.*").withColumn(
        "passed", F.col("first_value").isNotNull()
    )


def lag_mismatches(raw: DataFrame, lagged: DataFrame, features: list[str], axis: Axis = TICKS, k: int = 1) -> DataFrame:
    """Rows where a lagged feature is not the raw value ``k`` rows earlier, counted per feature."""
    on = [*axis.keys, *axis.order]
    expected = over_rows(
        raw.select(*on, *features), axis,
        lambda d, w: d.withColumns({f"_want_{c}": before(c, w, k) for c in features}), back=k,
    ).drop(*features)
    both = lagged.select(*on, *features).join(expected, on)
    return both.groupBy(*axis.keys).agg(
        F.count("*").alias("rows"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_want_{c}"))).alias(c) for c in features],
    ).unpivot([*axis.keys, "rows"], list(features), "feature", "mismatches").withColumn("passed", F.col("mismatches") == 0)


def usable_span(df: DataFrame, features: list[str], axis: Axis = TICKS, how: str = "all") -> DataFrame:
    """First and last usable row time and rows dropped per key.

    ``how='all'`` drops a row when every feature is missing, ``'any'`` when one is.
    """
    known = [F.col(c).isNotNull() for c in features]
    usable = known[0]
    for k in known[1:]:
        usable = usable | k if how == "all" else usable & k
    when = F.when(usable, F.col(axis.ts))
    return df.groupBy(*axis.keys).agg(
        F.min(when).alias("first_valid"), F.max(when).alias("last_valid"),
        F.count("*").alias("rows"), F.count_if(~usable).alias("rows_dropped"),
    )


def violations(df: DataFrame, checks: dict[str, Column], axis: Axis = TICKS) -> DataFrame:
    """Rows breaking each check, per key; a missing value breaks none. All checks in one pass."""
    counted = df.groupBy(*axis.keys).agg(*[F.count_if(~ok).alias(name) for name, ok in checks.items()])
    return counted.unpivot(list(axis.keys), list(checks), "check", "violations").withColumn(
        "passed", F.col("violations") == 0
    )


def within(c: str, low: float, high: float) -> Column:
    return F.col(c).between(low, high)


def feature_invariants(df: DataFrame, axis: Axis = TICKS, features=FEATURES, target: str = "ret_1m") -> DataFrame:
    """The six checks of a lagged feature table, per key."""
    ranges = violations(
        df,
        {
            "spread_positive": F.col("spread") > 0,
            "queue_imbalance_in_range": within("queue_imbalance", -1.0, 1.0),
            "trade_imbalance_in_range": within("trade_imbalance", -1.0, 1.0),
            "realized_vol_not_negative": F.col("realized_vol") >= 0,
        },
        axis,
    )
    leak = int(target in features)
    firsts = first_row_audit(df, ["ofi"], axis).select(
        *axis.keys,
        F.explode(
            F.array(
                F.struct(F.lit("first_row_missing").alias("check"), F.col("passed").cast("bigint").alias("violations")),
                F.struct(F.lit("target_not_a_feature").alias("check"), F.lit(leak).cast("bigint").alias("violations")),
            )
        ).alias("_c"),
    ).select(*axis.keys, "_c.*").withColumn("passed", F.col("violations") == 0)
    return ranges.unionByName(firsts)


def range_check(df: DataFrame, columns: list[str], axis: Axis = TICKS, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Lowest and highest value of normalised columns and whether they stay in range."""
    agg = df.groupBy(*axis.keys).agg(
        *[F.struct(F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["min"].alias("min"), F.col(c)["max"].alias("max")) for c in columns])
    return agg.select(*axis.keys, F.explode(rows).alias("_r")).select(*axis.keys, "_r.*").withColumn(
        "passed", F.coalesce((F.col("min") >= low) & (F.col("max") <= high), F.lit(True))
    )
