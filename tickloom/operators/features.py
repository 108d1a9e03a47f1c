"""The feature table, its targets and lags, and the leak-free model tables built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import queue_imbalance, quoted_spread, ratio, weighted_mid, zero_to_null
from ..plans import (
    POS, Axis, TICKS, after, attach, before, change, full_frames, lay_out, over_rows, rolling_mean, rolling_std, running,
    with_positions, with_rolling_sums,
)
from .ofi import OFI_SUMS, ofi_column
from .trades import amihud, count_imbalance, side_sign, simple_return, with_vwap

#: The sixteen features in their documented order.
FEATURES = (
    "ofi", "ofi_10s", "ofi_30s", "ofi_1m", "ofi_5m", "ofi_10m", "queue_imbalance", "trade_imbalance",
    "spread", "spread_change", "microprice", "vwap", "kyle_lambda", "amihud", "realized_vol", "ofi_norm",
)
#: Log-return targets, name to number of rows ahead.
TARGETS = {"ret_10s": 1, "ret_1m": 6, "ret_5m": 30}


def _feature_columns(price: str, volume: str):
    def build(d, w):
        d = d.withColumns(
            {
                "ofi": ofi_column(w, "signed_current"),
                "spread": quoted_spread(),
                "microprice": weighted_mid(),
                "queue_imbalance": queue_imbalance(empty="positive_only"),
                "_sign": side_sign(price),
                "_ret": simple_return(price, w),
            }
        ).withColumn("_signed", F.col("_sign") * F.col(volume))
        kept = [c for c in d.columns if c not in ("_sign", "_ret", "_signed")]
        rolled = ["spread_change", "trade_imbalance", "kyle_lambda", "amihud", "realized_vol", "ofi_norm"]
        # the states are added ahead of the sums and the values after them, so that they share their windows
        states, values = full_frames(w, 20, 5, kyle_lambda=("slope", "_ret", "_signed"), realized_vol=("std", "_ret"), _ofi_std=("std", "ofi"))
        d = d.withColumns(
            {
                "spread_change": change("spread", w),
                "trade_imbalance": count_imbalance(w, "_sign"),
                "amihud": amihud("_ret", volume),
                **states,
            }
        )
        d = with_rolling_sums(d, w, **{label: ("ofi", n) for label, n in OFI_SUMS.items()}).withColumns(values)
        d = d.withColumn("ofi_norm", ratio("ofi", zero_to_null("_ofi_std")))
        return d.select(*kept, *[c for c in (*rolled, *OFI_SUMS) if c not in kept])

    return build


def compute_features(df: DataFrame, axis: Axis = TICKS, price="trade_price", volume="volume") -> DataFrame:
    """All sixteen features of a tick table, from one ordering of the rows."""
    axis = axis.measured(df)
    d = with_vwap(lay_out(df, axis), axis, price, volume, laid_out=True)
    return over_rows(d, axis, _feature_columns(price, volume), back=60, laid_out=True).drop(POS)


def add_targets_and_lags(
    df: DataFrame, axis: Axis = TICKS, price="trade_price", targets=TARGETS, features=FEATURES,
) -> DataFrame:
    """Log forward returns, and every feature moved one row later in place."""

    def build(d, w):
        return d.withColumns({name: F.ln(ratio(after(price, w, k), price)) for name, k in targets.items()}).withColumns(
            {name: before(name, w) for name in features}
        )

    return over_rows(df, axis, build, back=1, ahead=max(targets.values()))


def lagged_feature_table(df: DataFrame, axis: Axis = TICKS, price="trade_price", volume="volume") -> DataFrame:
    """``compute_features`` and ``add_targets_and_lags`` over one ordering of the rows."""
    axis = axis.measured(df)
    d = with_vwap(lay_out(df, axis), axis, price, volume, laid_out=True)

    def build(d, w):
        d = _feature_columns(price, volume)(d, w)
        return d.withColumns({name: F.ln(ratio(after(price, w, k), price)) for name, k in TARGETS.items()}).withColumns(
            {name: before(name, w) for name in FEATURES}
        )

    return over_rows(d, axis, build, back=61, ahead=max(TARGETS.values()), laid_out=True).drop(POS)


def log_forward_returns(
    df: DataFrame, axis: Axis = TICKS, price: str = "price", horizons: dict[str, int] | None = None,
) -> DataFrame:
    """``target_{name}`` = ln(price k rows ahead / price), missing at the tail."""
    horizons = horizons or {"10s": 1, "1m": 6, "5m": 30}
    return over_rows(
        df, axis,
        lambda d, w: d.withColumns({f"target_{h}": F.ln(ratio(after(price, w, k), price)) for h, k in horizons.items()}),
        ahead=max(horizons.values()),
    )


def forward_return(
    df: DataFrame, axis: Axis = TICKS, price="weighted_mid", horizon: int = 1, whole_span: bool = False, out="forward_return",
) -> DataFrame:
    """The one-row return found ``horizon`` rows ahead; ``whole_span`` gives the return over all of them."""

    def build(d, w):
        start = F.col(price) if whole_span else after(price, w, horizon - 1) if horizon > 1 else F.col(price)
        return d.withColumn(out, ratio(after(price, w, horizon), start) - 1)

    return over_rows(df, axis, build, ahead=horizon)


def lag_features(df: DataFrame, features: list[str], axis: Axis = TICKS, lags=(1, 2, 3)) -> DataFrame:
    """``{feature}_lag{k}`` columns."""
    return over_rows(
        df, axis,
        lambda d, w: d.withColumns({f"{c}_lag{k}": before(c, w, k) for c in features for k in lags}),
        back=max(lags),
    )


def lag_in_place(df: DataFrame, features: list[str], axis: Axis = TICKS, k: int = 1) -> DataFrame:
    """Every feature replaced by its value ``k`` rows earlier."""
    return over_rows(df, axis, lambda d, w: d.withColumns({c: before(c, w, k) for c in features}), back=k)


def lag_model_table(
    df: DataFrame, axis: Axis = TICKS, price="price", bid_size="bid_size", ask_size="ask_size", volume="volume",
    lags=(1, 2, 3), ahead: int = 6,
) -> DataFrame:
    """Size-change OFI, queue imbalance and prior-window normalised features with their lags
    and a log target; rows complete in all of those only."""
    base = ["ofi", "queue_imbalance", "ofi_norm", "volume_norm"]

    def build(d, w):
        d = d.withColumns(
            {
                "ofi": ofi_column(w, "size_only", bid_size=bid_size, ask_size=ask_size),
                "queue_imbalance": queue_imbalance(bid_size, ask_size, empty="null"),
                "volume_norm": ratio(volume, rolling_mean(volume, w, 20, skip=1)),
                "target_1m": F.ln(ratio(after(price, w, ahead), price)),
            }
        ).withColumn("ofi_norm", ratio("ofi", rolling_std("ofi", w, 20, skip=1)))
        return d.withColumns({f"{c}_lag{k}": before(c, w, k) for c in base for k in lags})

    wide = over_rows(df, axis, build, back=21 + max(lags), ahead=ahead)
    return wide.na.drop("any", subset=[f"{c}_lag{k}" for c in base for k in lags] + ["target_1m"])


def chronological_split(df: DataFrame, axis: Axis = TICKS, train: float = 0.7, out: str = "is_train") -> DataFrame:
    """Flag the first ``int(train · n)`` rows of each key.

    Only the order columns are numbered, to find the last training row of each key; the rows
    themselves are compared with it where they are.
    """
    axis = axis.measured(df)
    sizes = df.groupBy(*axis.keys).agg(F.floor(F.lit(train) * F.count("*")).alias("_cut"))
    placed = attach(with_positions(df.select(*axis.keys, *axis.order), axis), sizes, axis.keys, axis.n_keys)
    last = placed.filter(F.col(POS) == F.col("_cut") - 1).select(*axis.keys, F.struct(*axis.order).alias("_last"))
    flagged = attach(df, last, axis.keys, axis.n_keys)
    return flagged.withColumn(out, F.coalesce(F.struct(*axis.order) <= F.col("_last"), F.lit(False))).drop("_last")


def backtest(df: DataFrame, axis: Axis = TICKS, price: str = "close", window: int = 20) -> DataFrame:
    """Long when the last return beats its rolling mean; equity compounds the next return.

    Rows without a full window or a next return are dropped before the equity curve starts.
    """
    axis = axis.measured(df)

    def build(d, w):
        d = d.withColumn("returns", simple_return(price, w))
        return d.withColumns(
            {
                "rolling_mean": rolling_mean("returns", w, window),
                "lag_returns": before("returns", w),
                "target": after("returns", w),
            }
        )

    ready = over_rows(df, axis, build, back=window, ahead=1).na.drop("any").withColumn(
        "signal", F.col("lag_returns") > F.col("rolling_mean")
    )
    ready = ready.withColumn("position", F.col("signal").cast("int")).withColumn(
        "strategy", F.col("position") * F.col("target")
    )
    return running(ready, axis, equity=("product", 1 + F.col("strategy")))
