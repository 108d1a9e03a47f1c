"""Order-flow imbalance at the touch: five definitions and their derivatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import ratio, zero_to_null
from ..plans import Axis, Rolling, TICKS, before, change, over_rows, with_rolling, with_rolling_sums

VARIANTS = ("cont", "reset", "signed_current", "size_only")

#: Row-window OFI sums of the feature table, label to number of rows.
OFI_SUMS = {"ofi_10s": 1, "ofi_30s": 3, "ofi_1m": 6, "ofi_5m": 30, "ofi_10m": 60}


def _side_flow(variant: str, price: Column, size: Column, improving: int, w: WindowSpec) -> Column:
    """Contribution of one side of the book; ``improving`` is +1 for bids and −1 for asks."""
    was, was_size = before(price, w), before(size, w)
    step = size - was_size
    better = price > was if improving > 0 else price < was
    worse = price < was if improving > 0 else price > was
    if variant == "cont":
        return F.when(better, size).when(price == was, step).otherwise(-was_size)
    if variant == "signed_current":
        return F.when(better, size).when(worse, -size).when(price == was, step).otherwise(F.lit(0))
    if variant == "reset":
        # an unknown previous price counts as a change, so the first row is the queue itself
        return F.when(F.coalesce(price != was, F.lit(True)), size).otherwise(step)
    if variant == "size_only":
        return step
    raise ValueError(f"variant must be one of {VARIANTS}, got {variant!r}")


def ofi_column(
    w: WindowSpec, variant: str = "cont", bid="bid_price", ask="ask_price",
    bid_size="bid_size", ask_size="ask_size",
) -> Column:
    """OFI of a row against the row before it.

    ``cont``: an improved price adds the whole queue, an unchanged one the size change, a worse
    (or unknown) one removes the whole previous queue; unknown results are 0.
    ``reset``: any price change counts the new queue in full, else the size change.
    ``signed_current``: as ``cont``, but a worse price removes the size now quoted.
    ``size_only``: the plain difference of size changes.
    """
    flow = _side_flow(variant, F.col(bid), F.col(bid_size), 1, w) - _side_flow(
        variant, F.col(ask), F.col(ask_size), -1, w
    )
    return F.coalesce(flow, F.lit(0)) if variant == "cont" else flow


def with_ofi(df: DataFrame, axis: Axis = TICKS, variant: str = "cont", out: str = "ofi", **columns) -> DataFrame:
    """Add tick-level OFI."""
    return over_rows(df, axis, lambda d, w: d.withColumn(out, ofi_column(w, variant, **columns)), back=1)


def with_rolling_ofi(df: DataFrame, axis: Axis = TICKS, windows=(5, 10), ofi: str = "ofi") -> DataFrame:
    """Rolling mean, std and sum of OFI for each window length."""

    def build(d, w):
        added = {f"ofi_{kind}_{n}": Rolling(kind, ofi, n) for n in windows for kind in ("mean", "std")}
        return with_rolling_sums(with_rolling(d, w, **added), w, **{f"ofi_sum_{n}": (ofi, n) for n in windows})

    return over_rows(df, axis, build, back=max(windows) - 1)


def with_ofi_sums(df: DataFrame, axis: Axis = TICKS, sums: dict[str, int] = OFI_SUMS, ofi: str = "ofi") -> DataFrame:
    """Sums of OFI over trailing numbers of rows."""
    return over_rows(
        df, axis,
        lambda d, w: with_rolling_sums(d, w, **{label: (ofi, n) for label, n in sums.items()}),
        back=max(sums.values()) - 1,
    )


def with_normalised(df: DataFrame, axis: Axis = TICKS, n: int = 20, **specs: dict) -> DataFrame:
    """Add ``name=dict(x=..., by=..., prior=..., guard=...)`` columns: ``x`` over its rolling std (or mean).

    ``prior`` leaves the current row out of the window; without ``guard`` a zero scale divides as it is.
    """
    scales = {f"_scale_{name}": Rolling(s.get("by", "std"), s["x"], n, skip=int(s.get("prior", False))) for name, s in specs.items()}

    def build(d, w):
        d = with_rolling(d, w, **scales)
        scale = lambda name, s: zero_to_null(f"_scale_{name}") if s.get("guard", True) else F.col(f"_scale_{name}")
        return d.withColumns({name: ratio(s["x"], scale(name, s)) for name, s in specs.items()}).drop(*scales)

    return over_rows(df, axis, build, back=n - 1 + max(s.skip for s in scales.values()))


def with_spread_change(df: DataFrame, axis: Axis = TICKS, spread: str = "spread", out="spread_change", round_dp=None) -> DataFrame:
    """Change of the spread from the row before."""

    def build(d, w):
        c = change(spread, w)
        return d.withColumn(out, c if round_dp is None else F.bround(c, round_dp))

    return over_rows(df, axis, build, back=1)


def ofi_summary(df: DataFrame, axis: Axis = TICKS, ofi: str = "ofi") -> DataFrame:
    """Mean, std and percentage of buy pressure per key."""
    return df.groupBy(*axis.keys).agg(
        F.avg(ofi).alias("mean_ofi"),
        F.stddev_samp(ofi).alias("std_ofi"),
        (F.avg((F.col(ofi) > 0).cast("double")) * 100).alias("pct_positive"),
        F.count(ofi).alias("n"),
    )
