"""Column expressions on one quote row: mid, microprice, spreads, queue imbalance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, ratio, round_to

#: Weights of book levels 1 to 5.
LEVEL_WEIGHTS = (1.0, 0.8, 0.6, 0.4, 0.2)


def mid_price(bid="bid_price", ask="ask_price") -> Column:
    return (col(bid) + col(ask)) / 2


def weighted_mid(
    bid="bid_price", ask="ask_price", bid_size="bid_size", ask_size="ask_size",
    empty_is_mid: bool = False, round_dp: int | None = None,
) -> Column:
    """Mid weighted by the opposite queue; missing (or the plain mid) when both queues are empty."""
    bid, ask, bid_size, ask_size = map(col, (bid, ask, bid_size, ask_size))
    total = bid_size + ask_size
    value = ratio(bid_size * ask + ask_size * bid, total)
    if empty_is_mid:
        value = F.when(total == 0, mid_price(bid, ask)).otherwise(value)
    return round_to(value, round_dp)


def quoted_spread(bid="bid_price", ask="ask_price") -> Column:
    return col(ask) - col(bid)


def effective_spread(price="trade_price", direction="direction", mid="mid_price", signed: bool = True) -> Column:
    """Twice the signed distance from the mid; ``signed=False`` takes the plain distance."""
    gap = col(price) - col(mid)
    return 2 * col(direction) * gap if signed else 2 * F.abs(gap)


def queue_imbalance(bid_size="bid_size", ask_size="ask_size", empty: str = "zero") -> Column:
    """(bid − ask) / (bid + ask) at the touch.

    ``empty`` says what an unusable total gives: ``zero`` (0 for a zero total, missing for a
    missing one), ``positive_only`` (0 for both) or ``null`` (missing for both).
    """
    b, a = col(bid_size), col(ask_size)
    value = ratio(b - a, b + a)
    if empty == "zero":
        return F.when(b + a == 0, F.lit(0.0)).otherwise(value)
    if empty == "positive_only":
        return F.when(b + a > 0, value).otherwise(F.lit(0.0))
    if empty == "null":
        return value
    raise ValueError(f"empty must be 'zero', 'positive_only' or 'null', got {empty!r}")


def queue_imbalance_levels(bid_sizes: list, ask_sizes: list, weights=LEVEL_WEIGHTS) -> Column:
    """Queue imbalance over several levels, each level counted with its weight."""
    if not len(bid_sizes) == len(ask_sizes) == len(weights):
        raise ValueError("one weight and two sizes are needed per level")
    bid = sum((F.lit(float(w)) * col(c) for w, c in zip(weights, bid_sizes)), F.lit(0.0))
    ask = sum((F.lit(float(w)) * col(c) for w, c in zip(weights, ask_sizes)), F.lit(0.0))
    return F.when(bid + ask == 0, F.lit(0.0)).otherwise(ratio(bid - ask, bid + ask))


def trade_side(price="trade_price", bid="bid_price", ask="ask_price") -> Column:
    """1 above the mid, −1 below it, 0 at it or when unknown."""
    mid = mid_price(bid, ask)
    return F.when(col(price) > mid, 1).when(col(price) < mid, -1).otherwise(0)
