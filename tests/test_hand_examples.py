"""Small inputs with exact answers."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import (
    effective_spread, mid_price, nan_to_null, queue_imbalance, queue_imbalance_levels, trade_side, weighted_mid,
)
from tickloom.operators import bars, clean, features, normalize, ofi, orderbook, rows, stats, trades, validate
from tickloom.plans import Axis


def series(spark, columns: dict, step: str = "10 seconds", start="2024-01-02 09:30:00"):
    """A one-symbol table from lists, at regular times."""
    names = list(columns)
    data = [(i, *(float(v) if isinstance(v, float) else v for v in vs)) for i, vs in enumerate(zip(*columns.values()))]
    kinds = ["double" if any(isinstance(v, float) for v in columns[n]) else "bigint" for n in names]
    df = spark.createDataFrame(data, "seq bigint, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return df.select(
        F.lit("A").alias("symbol"), F.expr(f"timestamp_ntz'{start}' + seq * interval {step}").alias("ts"), "seq", *names
    )


def column(df, name):
    return [r[name] for r in df.orderBy("seq").select(name).collect()]


def test_volume_bar_ids(spark):
    df = series(spark, {"volume": [200, 800, 100, 400, 600]})
    assert column(bars.volume_bar_ids(df, threshold=500), "bar_id") == [0, 2, 2, 3, 4]


def test_volume_bar_ids_with_negative_volume(spark):
    volumes = [300, 400, -900, 100, 2000, -50, 700]
    carried, bar, ids = 0, 0, []
    for v in volumes:
        carried += v
        while carried >= 500:
            carried, bar = carried - 500, bar + 1
        ids.append(bar)
    assert column(bars.volume_bar_ids(series(spark, {"volume": volumes}), threshold=500, signed=True), "bar_id") == ids


def test_full_sample_normalisation(spark):
    df = series(spark, {"x": [10, 50, 30]})
    axis = Axis()
    assert column(normalize.normalize_features(df, ["x"], axis), "x") == pytest.approx([1 / 3, 1.0, 2 / 3])
    assert column(normalize.normalize_features(df, ["x"], axis, "minmax"), "x") == [0.0, 1.0, 0.5]
    assert column(normalize.normalize_features(df, ["x"], axis, "zscore"), "x") == pytest.approx([-1.0, 1.0, 0.0])
    with pytest.raises(ValueError):
        normalize.normalize_features(df, ["x"], axis, "robust")


def test_constant_window_has_no_scale(spark):
    df = series(spark, {"x": [5.0] * 4})
    assert column(normalize.normalize_features(df, ["x"], method="zscore", window=3), "x") == [None] * 4
    assert column(normalize.normalize_features(df, ["x"], method="minmax"), "x") == [None] * 4
    assert column(normalize.normalize_features(df, ["x"], window=3), "x") == pytest.approx([1.0, 0.75, 2 / 3, 2 / 3])


def test_queue_imbalance(spark):
    df = series(spark, {"bid_size": [1000, 0, 0, 700, None], "ask_size": [0, 1000, 0, 300, 5]})
    out = df.select("seq", queue_imbalance().alias("a"), queue_imbalance(empty="positive_only").alias("b"), queue_imbalance(empty="null").alias("c"))
    assert column(out, "a") == [1.0, -1.0, 0.0, 0.4, None]
    assert column(out, "b") == [1.0, -1.0, 0.0, 0.4, 0.0]
    assert column(out, "c") == [1.0, -1.0, None, 0.4, None]


def test_deep_queue_imbalance(spark):
    df = series(spark, {"b1": [700, 0], "a1": [300, 0], "b2": [400, 0], "a2": [200, 0]})
    out = df.select("seq", queue_imbalance_levels(["b1", "b2"], ["a1", "a2"], (1.0, 0.8)).alias("q"))
    assert column(out, "q") == pytest.approx([(1020 - 460) / 1480, 0.0])


def test_trade_side_and_spreads(spark):
    df = series(spark, {"bid_price": [100.0] * 3, "ask_price": [100.10] * 3, "trade_price": [100.10, 100.00, 100.05]})
    out = df.withColumns({"direction": trade_side(), "mid_price": mid_price()})
    assert column(out, "direction") == [1, -1, 0]
    out = out.withColumns({"e": effective_spread(), "u": effective_spread(signed=False)})
    assert column(out, "e") == pytest.approx([0.1, 0.1, 0.0])
    assert column(out, "u") == pytest.approx([0.1, 0.1, 0.0])


SEED = [("buy", 100.0, 500), ("buy", 99.0, 300), ("buy", 98.0, 200), ("sell", 101.0, 400), ("sell", 102.0, 600), ("sell", 103.0, 100)]


def book(spark, events, seed=SEED):
    rows_ = [(s, p, q, True) for s, p, q in seed] + [(s, p, q, False) for s, p, q in events]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "seq bigint, side string, price double, quantity bigint, is_seed boolean")
    return df.select(F.lit("A").alias("symbol"), F.expr("timestamp_ntz'2024-01-02 09:30:00' + seq * interval 1 second").alias("ts"), "seq", "side", "price", "quantity", "is_seed")


def test_order_book(spark):
    events = book(spark, [("buy", 100.0, 300), ("sell", 101.0, 800), ("buy", 102.0, 600)])
    out = orderbook.touch_features(orderbook.book_ofi(events))
    assert column(out, "ofi") == [300, -800, 600]
    assert column(out, "bid_price") == [100.0, 100.0, 102.0]
    assert column(out, "bid_size") == [800, 800, 600]
    assert column(out, "queue_imbalance")[:2] == pytest.approx([1 / 3, -0.2])
    assert column(out, "weighted_mid")[0] == pytest.approx(100.6667, abs=1e-4)
    start = orderbook.touch_features(orderbook.touch(events.filter("is_seed"))).orderBy(F.desc("seq")).first()
    assert (start.bid_price, start.ask_price, start.mid_price) == (100.0, 101.0, 100.5)
    assert start.weighted_mid == pytest.approx(100.5556, abs=1e-4) and start.queue_imbalance == pytest.approx(0.1111, abs=1e-4)


def test_order_book_read_only_sometimes(spark):
    events = book(spark, [("buy", 100.0, 300), ("buy", 100.0, 50), ("sell", 101.0, 10)]).withColumn("read", F.col("seq") != 6)
    assert column(orderbook.book_ofi(events, observe="read"), "ofi") == [350, -10]


def test_order_book_rejects_an_unknown_side(spark):
    with pytest.raises(Exception, match="buy or the sell side"):
        orderbook.touch(book(spark, [("hold", 100.0, 1)])).collect()


def test_empty_queues(spark):
    df = series(spark, {"bid_price": [100.0], "ask_price": [101.0], "bid_size": [0], "ask_size": [0]})
    out = df.select("seq", weighted_mid(empty_is_mid=True).alias("w"), weighted_mid().alias("n"), queue_imbalance().alias("q")).first()
    assert (out.w, out.n, out.q) == (100.5, None, 0.0)


QUOTES = {"bid_price": [10.0, 11.0, 11.0, 10.5, 10.5], "ask_price": [12.0, 12.0, 11.5, 11.5, 12.0], "bid_size": [5, 7, 9, 4, 6], "ask_size": [8, 6, 3, 2, 10]}


@pytest.mark.parametrize(
    "variant, expected",
    [
        ("cont", [0, 7 - (6 - 8), (9 - 7) - 3, -9 - (2 - 3), (6 - 4) - (-2)]),
        ("reset", [5 - 8, 7 - (6 - 8), (9 - 7) - 3, 4 - (2 - 3), (6 - 4) - 10]),
        ("signed_current", [0, 7 - (6 - 8), (9 - 7) - 3, -4 - (2 - 3), (6 - 4) + 10]),
        ("size_only", [None, 2 - (-2), 2 - (-3), -5 - (-1), 2 - 8]),
    ],
)
def test_ofi_variants(spark, variant, expected):
    assert column(ofi.with_ofi(series(spark, QUOTES), variant=variant), "ofi") == expected


def test_ofi_with_missing_prices(spark):
    quotes = {"bid_price": [10.0, None, None, 10.0], "ask_price": [12.0] * 4, "bid_size": [5, 6, 7, 8], "ask_size": [1, 1, 1, 1]}
    df = series(spark, quotes)
    assert column(ofi.with_ofi(df, variant="cont"), "ofi") == [0, -5, -6, -7]
    assert column(ofi.with_ofi(df, variant="reset"), "ofi") == [4, 6, 7, 8]
    assert column(ofi.with_ofi(df, variant="signed_current"), "ofi") == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        ofi.with_ofi(df, variant="other").collect()


def test_log_targets_are_missing_at_the_tail(spark):
    df = series(spark, {"price": [100.0 + i for i in range(500)]})
    out = features.log_forward_returns(df)
    counts = stats.missing_counts(out.select("target_10s", "target_1m", "target_5m")).first()
    assert (counts.target_10s, counts.target_1m, counts.target_5m) == (1, 6, 30)
    assert column(out, "target_1m")[0] == pytest.approx(math.log(106 / 100))


def test_lag_model_table_size(spark):
    n = 500
    df = series(spark, {
        "price": [100.0 + math.sin(i) for i in range(n)], "bid_size": [100 + (i * 37) % 900 for i in range(n)],
        "ask_size": [100 + (i * 53) % 900 for i in range(n)], "volume": [50 + (i * 31) % 450 for i in range(n)],
    })
    out = features.lag_model_table(df)
    span = out.agg(F.min("ts").alias("a"), F.count("*").alias("n")).first()
    assert (span.n, str(span.a)) == (470, "2024-01-02 09:34:00")


def test_leakage_audit_span(spark):
    n = 100
    raw = series(spark, {"ofi": [float(i * 7 % 13) for i in range(n)], "microprice": [100.0 + i for i in range(n)]}, "1 minute")
    d = features.log_forward_returns(raw, price="microprice", horizons={"1m": 1})
    model = features.lag_in_place(d, ["ofi", "microprice"]).na.drop("any")
    span = model.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first()
    assert (span.n, str(span.a), str(span.b)) == (98, "2024-01-02 09:31:00", "2024-01-02 11:08:00")
    assert all(r.passed for r in validate.first_row_audit(model, ["ofi", "microprice"]).collect())
    assert all(r.passed for r in validate.lag_mismatches(raw, model, ["ofi", "microprice"]).collect())
    leaky = raw.withColumn("target_1m", F.lit(0.0))
    assert {r.feature: r.passed for r in validate.lag_mismatches(raw, leaky, ["ofi", "microprice"]).collect()} == {"ofi": False, "microprice": False}


def dirty(spark):
    n = 100
    price = [100.0 + i / 4 for i in range(n)]
    volume = [100 + i for i in range(n)]
    price[2], price[5], volume[7] = 0.0, -10.0, 999_999
    for i in (11, 23, 35, 47, 59):
        price[i] = None
    df = series(spark, {"price": price, "volume": volume}, "1 second")
    copies = df.filter(F.col("seq").isin(3, 17, 42, 77, 90)).withColumns({"seq": F.col("seq") + 1000, "price": F.lit(1.0)})
    return df.unionByName(copies)


def test_clean_ticks(spark):
    grid, audit = clean.clean_ticks(dirty(spark))
    a = audit.first()
    assert (a.rows_in, a.duplicates_removed, a.bad_prices_removed, a.prices_ffilled, a.bad_volume_removed, a.rows_out) == (105, 5, 7, 0, 1, 100)
    prices = [r.price for r in grid.orderBy("ts").collect()]
    assert len(prices) == 100 and prices[2] == prices[1] and prices[7] == prices[6] and prices[11] == prices[10]
    assert dict(grid.dtypes)["ts"] == "timestamp"
    with pytest.raises(TypeError):
        clean.to_utc(grid)


def test_clean_ticks_can_fill_gaps(spark):
    _, audit = clean.clean_ticks(dirty(spark), gap_policy="ffill")
    a = audit.first()
    assert (a.bad_prices_removed, a.prices_ffilled, a.bad_volume_removed) == (2, 5, 1)
    with pytest.raises(ValueError):
        clean.clean_ticks(dirty(spark), gap_policy="zero")


def test_grid_before_the_first_tick_is_missing(spark):
    df = series(spark, {"price": [1.0, 2.0, 3.0]}, "1.4 seconds", "2024-01-02 09:30:00.5")
    out = clean.regular_grid(df).orderBy("ts").collect()
    assert [(str(r.ts)[17:], r.price) for r in out] == [("00", None), ("01", 1.0), ("02", 2.0), ("03", 2.0)]


def test_trade_imbalance_warm_up_is_zero(spark):
    df = series(spark, {"bid_price": [99.0] * 12, "ask_price": [101.0] * 12, "trade_price": [101.0] * 12, "volume": [5] * 12})
    assert column(trades.with_trade_imbalance(df), "trade_imbalance") == [0.0] * 9 + [1.0] * 3


def test_all_trades_at_mid(spark):
    df = series(spark, {"bid_price": [99.0] * 12, "ask_price": [101.0] * 12, "trade_price": [100.0] * 12, "volume": [5] * 12})
    assert column(trades.with_trade_imbalance(df), "trade_imbalance") == [0.0] * 12


def test_roll_spread_needs_negative_covariance(spark):
    bounce = series(spark, {"mid_price": [100.0, 101.0] * 20})
    trend = series(spark, {"mid_price": [float(i * i) for i in range(20)]})
    assert trades.roll_spread(bounce).first().roll_spread == pytest.approx(2.0, rel=0.05)
    assert trades.roll_spread(trend).first().roll_spread is None


def test_forward_return_shift(spark):
    df = series(spark, {"mid_price": [100.0, 101.0, 103.0, 106.0], "ofi": [1, 2, 3, 4], "volume": [1, 0, 1, 1]})
    d = df.withColumn("horizon", F.lit("h")).withColumnRenamed("ts", "bar_start")
    axis = bars.bar_axis(Axis().measured(df), 1)
    late = bars.bar_signals(d, axis, complete=False).orderBy("seq").collect()
    assert late[0].forward_return == pytest.approx(103 / 101 - 1) and late[2].forward_return is None
    near = bars.bar_signals(d, axis, forward_skip=0, complete=False).orderBy("seq").collect()
    assert near[0].forward_return == pytest.approx(101 / 100 - 1)
    assert late[1].ofi_norm is None and late[1].ofi_lag1 == 1


def test_month_without_rows_is_zero(spark):
    df = spark.sql("SELECT 'A' AS symbol, d AS date, r AS ret FROM VALUES (date'2024-01-05', 0.5D), (date'2024-03-01', -0.25D), (date'2024-03-09', 0.0D) AS t(d, r)")
    axis = Axis(order=("date",))
    out = [(str(r.month_end), r.total) for r in bars.month_sums(df, axis).orderBy("month_end").collect()]
    assert out == [("2024-01-31", 0.5), ("2024-02-29", 0.0), ("2024-03-31", -0.25)]


def test_time_bars_skip_bins_without_price(spark):
    df = series(spark, {"price": [1.0, None, None, None, 5.0, 4.0], "volume": [1, 2, 3, 4, 5, 6]}, "30 seconds")
    out = [(r.open, r.high, r.low, r.close, r.volume) for r in bars.time_bars(df).orderBy("bar_start").collect()]
    assert out == [(1.0, 1.0, 1.0, 1.0, 3), (5.0, 5.0, 4.0, 4.0, 11)]


def test_prevailing_quote(spark):
    q = series(spark, {"bid_price": [1.0, 2.0], "ask_price": [2.0, 3.0], "bid_size": [1, 1], "ask_size": [1, 1]}, "60 seconds")
    t = series(spark, {"price": [1.5, 2.5, 9.0], "volume": [1, 1, 1]}, "60 seconds")
    out = trades.prevailing_quote(t, q, tolerance="30 seconds").orderBy("seq").collect()
    assert [r.bid_price for r in out] == [1.0, 2.0, None]
    assert [r.bid_price for r in trades.prevailing_quote(t, q).orderBy("seq").collect()] == [1.0, 2.0, 2.0]


def test_return_summary_of_lists(spark):
    d = trades.with_returns(series(spark, {"price": [100.0, 102.0, 103.0, 104.0, 105.0, 106.0]}))
    s = stats.return_summary(d).first()
    moves = [102 / 100 - 1, 103 / 102 - 1, 104 / 103 - 1, 105 / 104 - 1, 106 / 105 - 1]
    mean = sum(moves) / 5
    assert s.best == pytest.approx(0.02) and s.mean == pytest.approx(mean) and s.win_rate == 100.0
    assert s.variance == pytest.approx(sum((m - mean) ** 2 for m in moves) / 5)


def test_nan_becomes_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, 1), (float("nan"), 2)], "x double, k int"))
    assert [r.x for r in df.orderBy("k").collect()] == [1.0, None]
    assert rows.positive_only(df, "x").count() == 1


def test_session_hours_include_both_ends(spark):
    df = spark.sql("SELECT ts FROM VALUES (timestamp_ntz'2024-01-02 09:29:59.999999'), (timestamp_ntz'2024-01-02 09:30:00'), (timestamp_ntz'2024-01-02 16:00:00'), (timestamp_ntz'2024-01-02 16:00:00.000001') AS t(ts)")
    assert [str(r.ts)[11:] for r in rows.session_hours(df).collect()] == ["09:30:00", "16:00:00"]


def test_future_rows_never_change_the_past(spark):
    n = 120
    base = {
        "bid_price": [100.0 + (i * 7 % 5) / 4 for i in range(n)], "ask_price": [101.5 + (i * 3 % 4) / 4 for i in range(n)],
        "bid_size": [100 + i * 37 % 900 for i in range(n)], "ask_size": [100 + i * 91 % 900 for i in range(n)],
        "trade_price": [100.0 + (i * 11 % 9) / 4 for i in range(n)], "volume": [50 + i * 31 % 450 for i in range(n)],
    }
    cut = 80
    changed = {k: v[: cut + 1] + [x + type(x)(3) for x in v[cut + 1 :]] for k, v in base.items()}
    a = features.compute_features(series(spark, base)).filter(F.col("seq") <= cut).orderBy("seq").collect()
    b = features.compute_features(series(spark, changed)).filter(F.col("seq") <= cut).orderBy("seq").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_pipeline_sizes(spark):
    n = 1000
    df = series(spark, {
        "bid_price": [100.0 + (i * 7 % 5) / 4 for i in range(n)], "ask_price": [101.5 + (i * 3 % 4) / 4 for i in range(n)],
        "bid_size": [100 + i * 37 % 900 for i in range(n)], "ask_size": [100 + i * 91 % 900 for i in range(n)],
        "trade_price": [100.0 + (i * 11 % 9) / 4 for i in range(n)], "volume": [50 + i * 31 % 450 for i in range(n)],
    })
    whole = features.lagged_feature_table(df).na.drop("any", subset=[*features.FEATURES, "ret_1m"])
    split = features.chronological_split(whole).groupBy("is_train").count().collect()
    assert whole.count() == 934 and {r.is_train: r["count"] for r in split} == {True: 653, False: 281}
    two_steps = features.add_targets_and_lags(features.compute_features(df))
    key = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    assert key(two_steps) == key(features.lagged_feature_table(df))
