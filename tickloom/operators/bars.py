"""Time bars, OFI bars at several horizons, volume bars, calendar-month sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bin_start, col, interval_micros, ratio, zero_to_null
from ..plans import Axis, TICKS, after, before, over_rows, running

#: Horizons of the OFI bars, label to bar length.
HORIZONS = {"30s": "30 seconds", "1min": "1 minute", "5min": "5 minutes"}


def _known_at(x: Column, df: DataFrame, axis: Axis) -> Column:
    """The row order where ``x`` is known: first and last skip missing values."""
    return F.when(x.isNotNull(), axis.at(df))


def time_bars(
    df: DataFrame, axis: Axis = TICKS, freq: str = "1 minute", price: str = "price", volume: str = "volume",
) -> DataFrame:
    """Open, high, low, close and volume per left-closed bin; bins without a price are left out."""
    p, at = col(price), _known_at(col(price), df, axis)
    return (
        df.groupBy(*axis.keys, bin_start(axis.ts, interval_micros(freq)).alias("bar_start"))
        .agg(
            F.min_by(p, at).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, at).alias("close"),
            F.coalesce(F.sum(volume), F.lit(0)).alias("volume"),
        )
        .filter(F.col("open").isNotNull())
    )


def ofi_bars(
    df: DataFrame,
    axis: Axis = TICKS,
    horizons: dict[str, str] = HORIZONS,
    ofi: str = "ofi",
    mid: str = "mid_price",
    size: str = "volume",
    side: str = "direction",
) -> DataFrame:
    """OFI, last mid, volume and trade count per bar, one row per (key, horizon, bar).

    Ticks are aggregated once, to the largest bar that divides every horizon; each of those
    small bars is then counted into its bar of every horizon.
    """
    lengths = {label: interval_micros(freq) for label, freq in horizons.items()}
    finest = min(lengths.values())
    if any(us % finest for us in lengths.values()):
        finest = interval_micros("1 second")
        if any(us % finest for us in lengths.values()):
            raise ValueError("horizons must be whole multiples of the shortest one or of a second")
    small = df.groupBy(*axis.keys, bin_start(axis.ts, finest).alias("_bin")).agg(
        F.sum(ofi).alias("ofi"),
        F.max_by(mid, _known_at(col(mid), df, axis)).alias("mid_price"),
        F.sum(size).alias("volume"),
        F.count(side).alias("n_trades"),
    )
    each = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(us).alias("us")) for h, us in lengths.items()])
    )
    return (
        small.withColumn("_h", each)
        .groupBy(*axis.keys, F.col("_h.horizon").alias("horizon"), bin_start("_bin", F.col("_h.us")).alias("bar_start"))
        .agg(
            F.coalesce(F.sum("ofi"), F.lit(0)).alias("ofi"),
            F.max_by("mid_price", F.when(F.col("mid_price").isNotNull(), F.col("_bin"))).alias("mid_price"),
            F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
            F.sum("n_trades").alias("n_trades"),
        )
        .filter(F.col("mid_price").isNotNull())
    )


def bar_axis(axis: Axis, horizons: int = len(HORIZONS)) -> Axis:
    """The axis of OFI bars; a key has no more bars of one horizon than it had ticks."""
    return axis.by("horizon", groups=horizons).ordered_by("bar_start")


def bar_signals(bars: DataFrame, axis: Axis, forward_skip: int = 1, complete: bool = True) -> DataFrame:
    """Volume-normalised OFI, its lag and the forward return of each bar.

    ``forward_skip=1`` measures the return from the next bar to the one after it;
    ``forward_skip=0`` from this bar to the next. ``complete`` keeps only rows with no gap.
    """

    def signals(d, w):
        d = d.withColumn("ofi_norm", ratio("ofi", zero_to_null("volume")))
        start = after("mid_price", w, forward_skip) if forward_skip else F.col("mid_price")
        return d.withColumns(
            {
                "forward_return": ratio(after("mid_price", w, forward_skip + 1), start) - 1,
                "ofi_lag1": before("ofi", w),
                "ofi_norm_lag1": before("ofi_norm", w),
            }
        )

    out = over_rows(bars, axis, signals, back=1, ahead=forward_skip + 1)
    return out.na.drop("any") if complete else out


def volume_bar_ids(
    df: DataFrame, axis: Axis = TICKS, threshold: int = 500, volume: str = "volume",
    out: str = "bar_id", signed: bool = False,
) -> DataFrame:
    """Number of whole thresholds traded so far, the crossing tick belonging to the new bar.

    What is left over above a threshold counts toward the next bar. ``signed`` allows
    negative volumes, for which an id never goes back.
    """
    axis = axis.measured(df)
    d = running(df, axis, _traded=("sum", volume))
    d = d.withColumn(out, F.floor(F.col("_traded") / threshold)).drop("_traded")
    if signed:
        d = running(d, axis, _top=("max", out)).withColumn(out, F.greatest(F.lit(0), "_top")).drop("_top")
    return d


def volume_bars(
    df: DataFrame, axis: Axis = TICKS, threshold: int = 500, price: str = "price", volume: str = "volume",
    keep_id: bool = False,
) -> DataFrame:
    """One row per volume bar: last time, open, high, low, close, volume and VWAP."""
    p, v = col(price), col(volume)
    at = _known_at(p, df, axis)
    bars = (
        volume_bar_ids(df, axis, threshold, volume)
        .groupBy(*axis.keys, "bar_id")
        .agg(
            F.max(axis.ts).alias(axis.ts),
            F.min_by(p, at).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, at).alias("close"),
            F.sum(v).alias("total_volume"),
            ratio(F.sum(p * v), F.sum(v)).alias("vwap"),
        )
    )
    return bars if keep_id else bars.drop("bar_id")


def bar_uniformity(bars: dict[str, tuple[DataFrame, str]], axis: Axis = TICKS) -> DataFrame:
    """Mean, std, std/mean and count of bar volume per key for each kind of bar."""
    stacked = None
    for label, (df, volume) in bars.items():
        part = df.select(*axis.keys, F.lit(label).alias("bar_type"), F.col(volume).alias("volume"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*axis.keys, "bar_type").agg(
        F.avg("volume").alias("mean_volume"),
        F.stddev_samp("volume").alias("std_volume"),
        ratio(F.stddev_samp("volume"), F.avg("volume")).alias("cv"),
        F.count("volume").alias("n_bars"),
    )


def month_sums(df: DataFrame, axis: Axis, x: str = "ret", out: str = "total") -> DataFrame:
    """Sum per key and calendar month, labelled by its last day; a month without rows is 0."""
    monthly = df.groupBy(*axis.keys, F.trunc(axis.ts, "month").alias("_month")).agg(F.sum(x).alias(out))
    spine = (
        monthly.groupBy(*axis.keys)
        .agg(F.min("_month").alias("_a"), F.max("_month").alias("_b"))
        .withColumn("_month", F.explode(F.expr("sequence(_a, _b, interval 1 month)")))
        .drop("_a", "_b")
    )
    return spine.join(monthly, [*axis.keys, "_month"], "left").select(
        *axis.keys, F.last_day("_month").alias("month_end"), F.coalesce(out, F.lit(0)).alias(out)
    )


def month_extremes(months: DataFrame, axis: Axis, x: str = "total") -> DataFrame:
    """Worst and best month of each key with their sums; the earlier one on a tie."""
    earliest = F.col("month_end")
    return months.groupBy(*axis.keys).agg(
        F.min(F.struct(F.col(x), earliest)).alias("_worst"),
        F.max(F.struct(F.col(x), (-F.unix_date(earliest)).alias("d"), earliest)).alias("_best"),
    ).select(
        *axis.keys,
        F.col("_worst.month_end").alias("worst_month"), F.col(f"_worst.{x}").alias("worst"),
        F.col("_best.month_end").alias("best_month"), F.col(f"_best.{x}").alias("best"),
    )
