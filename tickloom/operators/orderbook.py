"""Order-book events to the best bid and ask, and OFI on the resulting touch.

An event adds ``quantity`` to one price level of one side. Levels are never removed: a level
whose size is zero still counts as the best one, and books may cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mid_price, queue_imbalance, weighted_mid
from ..plans import POS, Axis, TICKS, after, attach, before, lay_out, materialise, number_rows, over_rows, running


def touch(events: DataFrame, axis: Axis = TICKS, laid_out: bool = False) -> DataFrame:
    """Best bid and ask with their sizes after each event.

    The best price is a running extreme. A price that becomes the best was never seen before and, once passed, is never the
    best again, so its size is the running sum of the quantities at that price while it is the best: one more window inside the same
    keys, no look-up. A missing level changes nothing, and a missing quantity adds nothing. ``laid_out`` says that ``events``
    comes from ``lay_out`` with no row taken out since; otherwise the rows of a large key are numbered anew.
    """
    axis = axis.measured(events)
    side, price = F.col("side"), F.col("price")
    refused = F.concat(F.lit("an order is on the buy or the sell side, not "), F.coalesce(side, F.lit("NULL")))
    checked = events.withColumn("side", F.when(side.isin("buy", "sell"), side).otherwise(F.raise_error(refused)))
    best = {"bid_price": ("max", F.when(side == "buy", price)), "ask_price": ("min", F.when(side == "sell", price))}
    if not axis.fits or (laid_out and POS in events.columns):
        return _touch_in_runs(checked, axis, best, laid_out and POS in events.columns)
    best = running(checked, axis, **best)
    for name, on in (("bid", "buy"), ("ask", "sell")):
        here = F.when((side == on) & (price == F.col(f"{name}_price")), F.col("quantity"))
        best = running(best, axis.by(f"{name}_price"), **{f"{name}_size": ("sum", here)})
    return best


def _touch_in_runs(events: DataFrame, axis: Axis, best: dict, laid_out: bool) -> DataFrame:
    """``touch`` of keys cut into runs, in one exchange of the rows: each run starts from the touch that the earlier runs left.

    Two small aggregates tell that touch: the best prices of each run, and the quantity each run has at the price that is the best
    when it ends. Earlier runs that ended at the same price add theirs.
    """
    keys, run = list(axis.keys), [*axis.keys, "_run"]
    rows = events if laid_out else number_rows(events.drop(POS), axis)
    rows = rows.withColumns({"_run": F.expr(f"{POS} div {axis.rows_per_task}L"), "_bid": best["bid_price"][1], "_ask": best["ask_price"][1]})
    upto = W.partitionBy(*keys).orderBy("_run")
    left = rows.groupBy(*run).agg(F.max("_bid").alias("_bid_end"), F.min("_ask").alias("_ask_end"))
    left = materialise(left.withColumns({"_bid_end": F.max("_bid_end").over(upto), "_ask_end": F.min("_ask_end").over(upto)}))
    runs = (axis.total if axis.total is not None else axis.widest * (axis.n_keys or 1)) // axis.rows_per_task + (axis.n_keys or axis.rows_per_task)
    ends = attach(rows.select(*run, "_bid", "_ask", "quantity"), left, tuple(run), runs).groupBy(*run, "_bid_end", "_ask_end").agg(
        *[F.sum(F.when(F.col(f"_{s}") == F.col(f"_{s}_end"), F.col("quantity"))).alias(f"_{s}_sum") for s in ("bid", "ask")]
    )
    # what earlier runs left enters each run as one more row, ahead of its first
    for s in ("bid", "ask"):
        same = W.partitionBy(*keys, f"_{s}_end").orderBy("_run")
        ends = ends.withColumn(f"_{s}_left", F.sum(f"_{s}_sum").over(same))
    carried = ends.select(
        *keys, (F.col("_run") + 1).alias("_run"), F.lit(-1).cast("bigint").alias(POS), F.col("_bid_end").alias("_bid"), F.col("_ask_end").alias("_ask"),
        F.col("_bid_left").alias("_bid_more"), F.col("_ask_left").alias("_ask_more"),
    )
    none = F.lit(None).cast(carried.schema["_bid_more"].dataType)
    met = rows.withColumns({"_bid_more": F.when(F.col("_bid").isNotNull(), F.col("quantity")).otherwise(none), "_ask_more": F.when(F.col("_ask").isNotNull(), F.col("quantity")).otherwise(none)})
    met = met.unionByName(carried, allowMissingColumns=True)
    within = W.partitionBy(*run).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    met = met.withColumns({"bid_price": F.max("_bid").over(within), "ask_price": F.min("_ask").over(within)})
    for s in ("bid", "ask"):
        level = W.partitionBy(*run, f"{s}_price").orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
        met = met.withColumn(f"{s}_size", F.sum(F.when(F.col(f"_{s}") == F.col(f"{s}_price"), F.col(f"_{s}_more"))).over(level))
    out = met.filter(F.col(POS) >= 0).drop("_run", "_bid", "_ask", "_bid_more", "_ask_more")
    return out if laid_out else out.drop(POS)


def touch_features(df: DataFrame) -> DataFrame:
    """Mid, size-weighted mid and queue imbalance of a touch."""
    return df.withColumns(
        {
            "mid_price": mid_price(),
            "weighted_mid": weighted_mid(empty_is_mid=True),
            "queue_imbalance": queue_imbalance(),
        }
    )


def book_ofi(
    events: DataFrame, axis: Axis = TICKS, seed: str = "is_seed", observe: str | None = None, laid_out: bool = False,
) -> DataFrame:
    """OFI between successive readings of the book.

    Rows flagged ``seed`` build the starting book; its state is what the first reading is
    compared with. ``observe`` flags the events after which the book is read (default: each).
    A changed best price counts the new queue in full, else the size change. ``laid_out`` as in ``touch``.
    """
    axis = axis.measured(events)
    laid_out = laid_out and POS in events.columns
    if not laid_out:
        events = lay_out(events, axis)

    def last_seed(d, w):
        more = F.coalesce(after(seed, w), F.lit(False))
        return d.withColumn("_base", F.col(seed) & ~more)

    read = ~F.col(seed) & (F.col(observe) if observe else F.lit(True))
    marked = over_rows(events, axis, last_seed, ahead=1, laid_out=True)
    states = touch(marked, axis, laid_out=True).filter(F.col("_base") | read).drop(POS)

    def flow(d, w):
        def one(price, size):
            moved = F.coalesce(F.col(price) != before(price, w), F.lit(True))
            return F.when(moved, F.col(size)).otherwise(F.col(size) - before(size, w))

        return d.withColumn("ofi", one("bid_price", "bid_size") - one("ask_price", "ask_size"))

    return over_rows(states, axis, flow, back=1).filter(~F.col(seed)).drop("_base")
