"""Trades against quotes: as-of join, rolling trade pressure, VWAP, price impact, Roll spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import interval_micros, mid_price, micros, ratio, trade_side, zero_to_null
from ..plans import (
    Axis, TICKS, before, change, over_rows, rolling_mean, running, trailing, with_rolling_sums,
)


def prevailing_quote(
    trades: DataFrame, quotes: DataFrame, axis: Axis = TICKS, tolerance: str | None = None,
    columns: tuple[str, ...] = ("bid_price", "ask_price", "bid_size", "ask_size"),
) -> DataFrame:
    """Each trade with the last quote at or before it, in one pass over both tables.

    The tables are stacked in time order, a quote ahead of a trade of the same time, and the
    last quote is carried forward. A trade without a quote (or with one older than
    ``tolerance``) keeps missing quote columns.
    """
    ts, seq = axis.order[:2]
    quote = F.struct(F.col(ts).alias("quote_ts"), *columns)
    trade_columns = [c for c in trades.columns]
    empty_quote = {"_quote": F.lit(None).cast(quotes.select(quote.alias("q")).schema["q"].dataType)}
    stacked = trades.withColumns({"_kind": F.lit(1), **empty_quote}).unionByName(
        quotes.select(*axis.keys, ts, seq, F.lit(0).alias("_kind"), quote.alias("_quote")),
        allowMissingColumns=True,
    )
    timeline = axis.unmeasured().ordered_by(ts, "_kind", seq).measured(stacked)
    carried = running(stacked, timeline, _last=("last", "_quote")).filter("_kind = 1")
    if tolerance is not None:
        age = micros(ts) - micros("_last.quote_ts")
        carried = carried.withColumn("_last", F.when(age <= interval_micros(tolerance), F.col("_last")))
    return carried.select(*trade_columns, "_last.*")


def with_trade_imbalance(
    df: DataFrame, axis: Axis = TICKS, window: int = 10, price="trade_price", volume="volume",
    bid="bid_price", ask="ask_price", out="trade_imbalance",
) -> DataFrame:
    """Trade side and rolling (buy − sell) / (buy + sell) volume; 0 until the window is full."""

    def build(d, w):
        side = trade_side(price, bid, ask)
        d = d.withColumns(
            {
                "direction": side,
                "buy_vol": F.when(side == 1, F.col(volume)).otherwise(0),
                "sell_vol": F.when(side == -1, F.col(volume)).otherwise(0),
            }
        )
        d = with_rolling_sums(d, w, _buy=("buy_vol", window), _sell=("sell_vol", window))
        total, net = F.col("_buy") + F.col("_sell"), F.col("_buy") - F.col("_sell")
        return d.withColumn(out, F.when(total > 0, ratio(net, total)).otherwise(F.lit(0.0))).drop("_buy", "_sell")

    return over_rows(df, axis, build, back=window - 1)


def side_sign(price="trade_price", bid="bid_price", ask="ask_price") -> Column:
    """Sign of the distance from the mid; missing when a price is."""
    return F.signum(F.col(price) - mid_price(bid, ask))


def count_imbalance(w: WindowSpec, sign: str | Column, n: int = 6) -> Column:
    """Rolling mean of trade signs."""
    return rolling_mean(sign, w, n)


def simple_return(x: str | Column, w: WindowSpec) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return ratio(x, F.lag(x, 1).over(w)) - 1


def kyle_lambda(ret: str | Column, signed_volume: str | Column, w: WindowSpec, n: int = 20) -> Column:
    """Rolling covariance of returns with signed volume over the variance of signed volume.

    In a frame of ``n`` whole pairs that is the slope of a line through them, which is one
    aggregate and missing for a constant volume.
    """
    ret = F.col(ret) if isinstance(ret, str) else ret
    volume = F.col(signed_volume) if isinstance(signed_volume, str) else signed_volume
    frame = trailing(w, n)
    return F.when(F.count(ret * volume).over(frame) >= n, F.regr_slope(ret, volume).over(frame))


def amihud(ret: str | Column, volume: str | Column = "volume") -> Column:
    """Absolute return per share traded; missing for zero volume."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    return ratio(F.abs(ret), zero_to_null(volume))


def with_returns(
    df: DataFrame, axis: Axis = TICKS, price: str = "price", out: str = "ret", log: bool = False, ffill: bool = False,
) -> DataFrame:
    """Simple (or log) return against the row before; ``ffill`` bridges missing prices first."""
    if ffill:
        df = running(df, axis, _px=("last", price))
        price = "_px"

    def build(d, w):
        if not log:
            return d.withColumn(out, simple_return(price, w))
        return d.withColumn(out, F.ln(ratio(price, before(price, w))))

    return over_rows(df, axis, build, back=1).drop("_px")


def with_vwap(df: DataFrame, axis: Axis = TICKS, price="trade_price", volume="volume", out="vwap", laid_out: bool = False) -> DataFrame:
    """Volume-weighted price from the first row of the key; add a session key to restart it."""
    value = F.col(price) * F.col(volume)
    d = running(df, axis, laid_out=laid_out, _pv=("sum", value), _v=("sum", volume))
    return d.withColumn(out, F.when(value.isNotNull(), ratio("_pv", "_v"))).drop("_pv", "_v")


def roll_spread(df: DataFrame, axis: Axis = TICKS, mid: str = "mid_price") -> DataFrame:
    """Spread implied by the serial covariance of price changes, per key; missing when it is not negative."""

    def build(d, w):
        return d.withColumn("_dp", change(mid, w)).withColumn("_dp1", before("_dp", w))

    moves = over_rows(df, axis, build, back=2)
    return moves.groupBy(*axis.keys).agg(F.covar_samp("_dp", "_dp1").alias("serial_cov")).withColumn(
        "roll_spread", F.when(F.col("serial_cov") < 0, 2 * F.sqrt(-F.col("serial_cov")))
    )
