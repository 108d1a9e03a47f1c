"""Each ordered operator gives the same rows when every key is too large for one task."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickloom.functions import mid_price, trade_side, weighted_mid
from tickloom.operators import bars, clean, features, models, normalize, ofi, orderbook, rows, stats, trades, validate
from tickloom.plans import DAILY, TICKS, discard_materialised
from tickloom.sources import market_table


def ticks(spark, folder):
    return market_table(spark, folder, "ticks").withColumns({"mid_price": mid_price(), "direction": trade_side(), "weighted_mid": weighted_mid()})


def signals(spark, folder, axis):
    b = bars.ofi_bars(ofi.with_ofi(ticks(spark, folder), axis), axis, {"6h": "6 hours", "1d": "1 day"})
    return bars.bar_signals(b, bars.bar_axis(axis, 2)), bars.bar_axis(axis, 2)


CASES = {
    "asof": lambda s, f, a: trades.prevailing_quote(market_table(s, f, "trades"), market_table(s, f, "quotes"), a),
    "touch": lambda s, f, a: orderbook.touch(market_table(s, f, "order_events"), a),
    "book_ofi": lambda s, f, a: orderbook.book_ofi(market_table(s, f, "order_events").withColumn("is_seed", F.col("ts") < "2024-01-02"), a),
    "clean": lambda s, f, a: clean.clean_ticks(market_table(s, f, "dirty"), a, "1 hour", "ffill")[0],
    "audit": lambda s, f, a: clean.clean_ticks(market_table(s, f, "dirty"), a, "1 hour")[1],
    "volume_bars": lambda s, f, a: bars.volume_bars(ticks(s, f), a, price="trade_price", keep_id=True),
    "signed_ids": lambda s, f, a: bars.volume_bar_ids(ticks(s, f).withColumn("volume", F.col("volume") - 200), a, signed=True),
    "signals": lambda s, f, a: signals(s, f, a)[0],
    "ic": lambda s, f, a: stats.rank_ic(*signals(s, f, a), min_obs=10),
    "acf": lambda s, f, a: stats.autocorrelation(*signals(s, f, a)),
    "adf": lambda s, f, a: models.unit_root(*signals(s, f, a)),
    "features": lambda s, f, a: features.compute_features(ticks(s, f), a),
    "targets": lambda s, f, a: features.add_targets_and_lags(features.compute_features(ticks(s, f), a), a),
    "rolling_ofi": lambda s, f, a: ofi.with_rolling_ofi(ofi.with_ofi(ticks(s, f), a, "reset"), a),
    "normalised": lambda s, f, a: ofi.with_normalised(ofi.with_ofi(ticks(s, f), a), a, z=dict(x="ofi", prior=True), v=dict(x="volume", by="mean")),
    "imbalance": lambda s, f, a: trades.with_trade_imbalance(ticks(s, f), a),
    "roll": lambda s, f, a: trades.roll_spread(ticks(s, f), a),
    "lag_table": lambda s, f, a: features.lag_model_table(ticks(s, f), a, price="trade_price"),
    "forward": lambda s, f, a: features.forward_return(ticks(s, f), a, horizon=4),
    "split": lambda s, f, a: features.chronological_split(ticks(s, f), a),
    "backtest": lambda s, f, a: features.backtest(market_table(s, f, "daily"), replace(DAILY, rows_per_task=a.rows_per_task)),
    "rank": lambda s, f, a: normalize.normalize_features(ticks(s, f), ["volume", "trade_price"], a),
    "rolling_rank": lambda s, f, a: normalize.normalize_features(ticks(s, f), ["volume"], a, window=20),
    "winsorise": lambda s, f, a: rows.winsorise(ticks(s, f), a, "volume"),
    "ridge": lambda s, f, a: models.ridge_baseline(features.log_forward_returns(ticks(s, f), a, "trade_price"), ["volume", "bid_size"], a, "target_1m"),
    "lag_check": lambda s, f, a: validate.lag_mismatches(ticks(s, f), features.lag_in_place(ticks(s, f), ["volume"], a), ["volume"], a),
    "gaps": lambda s, f, a: stats.spacing_counts(ticks(s, f), a),
}


def content(df):
    columns = sorted(df.columns)

    def tidy(v):
        return round(v, 7) + 0.0 if isinstance(v, float) else v

    return sorted(str([tidy(r[c]) for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", list(CASES))
def test_split_equals_plain(spark, folder, name):
    plain = content(CASES[name](spark, folder, TICKS))
    split = content(CASES[name](spark, folder, replace(TICKS, rows_per_task=70)))
    assert plain and split == plain


def test_written_tables_can_be_discarded(spark):
    assert discard_materialised(spark) > 0
    assert discard_materialised(spark) == 0
