"""Answers and plans that must not hang on a stale or arbitrary size."""

import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tickloom.functions.closed_forms import _student_tail
from tickloom.operators import clean, models, orderbook
from tickloom.operators.features import FEATURES
from tickloom.plans import Axis, average_rank, lay_out, over_rows, rolling_sum, running
from tickloom.plans import layout
from tickloom.sources import market_table
from tickloom.sources.files import read_parquet
from tickloom.streaming.ordered import BookProcessor

T0 = dt.datetime(2024, 1, 2, 9, 30)


def tail_by_steps(t, df, steps=200_000):
    """Two-sided tail by Simpson's rule over the angle, to about 1e-12."""
    top = math.atan(t / math.sqrt(df))
    f = lambda a: math.exp((df - 1) * math.log(math.cos(a))) if a < math.pi / 2 else 0.0
    span = min(math.pi / 2 - top, 14 / math.sqrt(df) if df > 50 else math.pi)
    h = span / steps
    area = f(top) + f(top + span) + sum((4 if k % 2 else 2) * f(top + k * h) for k in range(1, steps))
    log_b = math.lgamma(0.5) + math.lgamma(df / 2) - math.lgamma(df / 2 + 0.5)
    return 2 * area * h / 3 / math.exp(log_b)


@pytest.mark.parametrize("t, df", [(2.0, 3), (0.3, 7), (2.5, 11), (6.0, 30), (1.0, 400), (4.0, 1500)])
def test_student_tail_is_the_integral(t, df):
    assert _student_tail(t, df) == pytest.approx(tail_by_steps(t, df), rel=1e-9)


def test_student_tail_in_closed_form():
    for t in (0.1, 1.0, 7.0):
        assert _student_tail(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-12)
        assert _student_tail(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    assert _student_tail(0.0, 5) == 1.0 and _student_tail(math.inf, 5) == 0.0


@pytest.mark.parametrize("t", [0.5, 1.8, 6.0])
@pytest.mark.parametrize("df", [1e5, 1e6, 1e7, 1e9])
def test_student_tail_of_very_many_rows(t, df):
    """The expansion around the normal tail in powers of 1/df, to second order."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = t * (t * t + 1) / (4 * df)
    second = t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (96 * df * df)
    want = math.erfc(t / math.sqrt(2)) + 2 * density * (first + second)
    assert _student_tail(t, df) == pytest.approx(want, rel=1e-8 if t > 3 and df < 1e6 else 1e-10, abs=0)


def test_student_tail_has_no_step_at_a_million():
    for t in (1.0, 6.0):
        assert _student_tail(t, 1_000_001) == pytest.approx(_student_tail(t, 1_000_000), rel=1e-4)
        assert 0 < _student_tail(t, 1_000_000) - _student_tail(t, 1_000_001) < 1e-9


def test_grid_is_measured_again(spark):
    rows = [("A", T0, 0, 1.0, 5), ("A", T0 + dt.timedelta(seconds=500), 1, 2.0, 6)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, volume long")
    axis = Axis(rows_per_task=50).measured(df)
    grid = clean.regular_grid(df, axis, "1 second")
    assert axis.widest == 2 and axis.measured(grid).widest == 501 and not axis.measured(grid).fits
    assert axis.measured(grid.filter("price > 0").withColumn("x", F.lit(1))).widest == 501
    zoned = clean.to_utc(grid)
    assert axis.measured(zoned).widest == 501
    again = axis.measured(grid)
    assert again.measured(grid) is again and again.measured(df) is again


def test_filter_after_layout(spark, folder):
    axis = Axis(rows_per_task=40)
    ticks = market_table(spark, folder, "ticks")
    laid = lay_out(ticks, axis).filter("seq % 3 <> 0")
    plain = ticks.filter("seq % 3 <> 0")
    total = lambda d, w: d.withColumn("s", rolling_sum("volume", w, 10))
    rows = lambda d: sorted((r["symbol"], r["ts"], r["seq"], r["s"]) for r in d.collect())
    assert rows(over_rows(laid, axis, total, back=9)) == rows(over_rows(plain, Axis(), total, back=9))
    assert rows(running(laid, axis, s=("sum", "volume"))) == rows(running(plain, Axis(), s=("sum", "volume")))


def test_frequent_values_lie_in_many_cuts(spark, monkeypatch):
    rows = [("A", T0, i, float(i % 4) if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, x double")
    got = lambda axis: sorted((r["seq"], r["r"]) for r in average_rank(df, axis, r="x").collect())
    want = got(Axis())
    assert got(Axis(rows_per_task=20)) == want
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 0)
    assert got(Axis(rows_per_task=7)) == want


def test_short_key_stays_in_the_ridge_report(spark, folder):
    from tickloom.operators.features import lagged_feature_table

    table = lagged_feature_table(market_table(spark, folder, "ticks"))
    columns = [c for c in FEATURES[:2]]
    table = table.select("symbol", "ts", "seq", *columns, "ret_1m").na.drop("any")
    two = table.limit(2).withColumn("symbol", F.lit("SHORT"))
    out = {r["symbol"]: r for r in models.ridge_baseline(table.unionByName(two), columns).collect()}
    assert "SHORT" in out and out["SHORT"]["oos_ic"] is None and len(out) == 1 + table.select("symbol").distinct().count()


ORDERS = [("buy", 10.0, 5), ("buy", 9.0, 4), ("sell", 11.0, 3), ("buy", None, 7), ("buy", 10.0, None), ("buy", 10.0, -5), ("sell", 11.0, 2), ("sell", 10.5, 1), ("buy", 12.0, None), ("buy", 12.0, 8), ("sell", 11.0, 9)]


def plain_touch(orders):
    levels, out = {}, []
    for side, price, quantity in orders:
        if price is not None:
            had = levels.get((side, price))
            levels[side, price] = had if quantity is None else (had or 0) + quantity
        bids, asks = ([p for s, p in levels if s == x] for x in ("buy", "sell"))
        bid, ask = max(bids, default=None), min(asks, default=None)
        out.append((bid, ask, levels.get(("buy", bid)), levels.get(("sell", ask))))
    return out


@pytest.mark.parametrize("rows_per_task", [500_000, 3])
def test_touch_with_missing_levels(spark, rows_per_task):
    rows = [("A", T0, i, *o) for i, o in enumerate(ORDERS)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, side string, price double, quantity long")
    got = sorted((r["seq"], r["bid_price"], r["ask_price"], r["bid_size"], r["ask_size"]) for r in orderbook.touch(df, Axis(rows_per_task=rows_per_task)).collect())
    assert [g[1:] for g in got] == plain_touch(ORDERS)


class _Value:
    kept = None

    def exists(self):
        return self.kept is not None

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value


def test_live_touch_agrees(spark):
    book = BookProcessor()
    book.touch = _Value()
    rows = [(i, i, *o, False) for i, o in enumerate(ORDERS)]
    out = book.advance("A", rows[:4]) + book.advance("A", rows[4:])
    assert [r[3:7] for r in out] == plain_touch(ORDERS)


def test_touch_plan_has_no_join(spark, folder):
    axis = Axis().measured(market_table(spark, folder, "order_events"))
    plan = orderbook.touch(market_table(spark, folder, "order_events"), axis)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_first_arrivals_of_fixed_width_are_hashed(spark, folder):
    df = market_table(spark, folder, "dirty")
    assert "SortAggregate" not in clean.first_arrivals(df)._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame([(1.0,), (6.0,), (float("nan"),), (None,)], "value double").write.parquet(path)
    df = read_parquet(spark, path, where="value > 5")
    assert [r["value"] for r in df.collect()] == [6.0]
    assert "GreaterThan(value,5.0)" in df._jdf.queryExecution().executedPlan().toString()
    assert replace(Axis(), widest=3).fits
