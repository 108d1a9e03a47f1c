"""Rolling states of blocks, order statistics, ranks in cuts and lagged products against direct computation."""

import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features, models
from tickloom.operators.normalize import normalize_features
from tickloom.operators.trades import kyle_lambda
from tickloom.plans import Axis, Rolling, average_rank, full_frames, over_rows, quantiles, ranking, rolling_rank, rolling_std, with_rolling
from tickloom.plans.orderstat import count_below, trailing_ranks

SCHEMA = "symbol string, ts long, seq long, x double, y double, k long"


def series(n, seed, gaps=0.15):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < gaps else rng.choice([0.0, 1.5, rng.gauss(0, 3)])
    return [(i // 3, i, value(), value(), None if rng.random() < gaps else rng.randint(-9, 9)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(s, *r) for s, n in (("HOT", 230), ("cool", 41), ("one", 1)) for r in series(n, len(s))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache()


def exact(kind, pairs):
    """One rolling value in exact arithmetic."""
    x = [Fraction(a) for a, _ in pairs]
    n = len(x)
    if kind == "count":
        return n
    if not n:
        return None
    if kind in ("sum", "min", "max"):
        return {"sum": sum, "min": min, "max": max}[kind](x)
    mean = sum(x) / n
    if kind == "mean":
        return mean
    if kind in ("var", "std"):
        var = sum((v - mean) ** 2 for v in x) / (n - 1) if n > 1 else None
        return var if var is None or kind == "var" else float(var) ** 0.5
    y = [Fraction(b) for _, b in pairs]
    my = sum(y) / n
    xy, yy = sum((a - mean) * (b - my) for a, b in zip(x, y)), sum((b - my) ** 2 for b in y)
    if n < 2:
        return None
    return xy / (n - 1) if kind == "cov" else xy / yy if yy else None


def wanted(rows, r: Rolling):
    out = {}
    for at in range(len(rows)):
        end = at - r.skip + 1
        frame = rows[max(0, end - r.n) : max(0, end)]
        pairs = [(f[r.x], f[r.y] if r.y else 0) for f in frame if f[r.x] is not None and (r.y is None or f[r.y] is not None)]
        need = r.n if r.need is None else r.need
        value = exact(r.kind, pairs) if len(pairs) >= need and (pairs or r.kind == "count") else None
        if r.skip and at < r.skip:
            value = None
        out[rows[at]["seq"]] = value
    return out


@pytest.mark.parametrize("rows_per_task", [500_000, 40])
def test_rolling_values_are_exact(table, rows_per_task):
    specs = {f"{kind}_{n}_{skip}": Rolling(kind, "x", n, y="y" if kind in ("cov", "slope") else None, need=need, skip=skip)
             for kind in ("count", "sum", "mean", "var", "std", "min", "max", "cov", "slope") for n, need, skip in ((1, None, 0), (5, 1, 0), (7, 3, 2), (60, 1, 0))}
    specs["whole_sum"] = Rolling("sum", "k", 12, need=1)
    df = over_rows(table, Axis(rows_per_task=rows_per_task), lambda d, w: with_rolling(d, w, **specs), back=64)
    assert df.columns[:6] == table.columns and dict(df.dtypes)["whole_sum"] == "bigint"
    got = {(r["symbol"], r["seq"]): r for r in df.collect()}
    for symbol in ("HOT", "cool", "one"):
        rows = [r.asDict() for r in sorted((r for r in got.values() if r["symbol"] == symbol), key=lambda r: r["seq"])]
        for name, spec in specs.items():
            for seq, want in wanted(rows, spec).items():
                value = got[symbol, seq][name]
                assert (value is None) == (want is None), (name, symbol, seq, value, want)
                if want is not None:
                    assert value == pytest.approx(float(want), rel=1e-9, abs=1e-9), (name, symbol, seq)


def test_large_prices_with_small_moves(spark):
    """Prices of a million that move by a thousandth: what is exact to twelve digits stays so."""
    rng = random.Random(3)
    rows = [("A", i, i, 1e6 + rng.gauss(0, 1e-3), 2e6 + rng.gauss(0, 1e-3), 0) for i in range(600)]
    spec = {"s": Rolling("var", "x", 50), "c": Rolling("cov", "x", 50, y="y"), "m": Rolling("mean", "x", 50)}
    out = with_rolling(spark.createDataFrame(rows, SCHEMA), Axis().window(), **spec).orderBy("seq").collect()
    for i in range(49, 600):
        pairs = [(r[3], r[4]) for r in rows[i - 49 : i + 1]]
        var = float(exact("var", pairs))
        assert out[i]["s"] == pytest.approx(var, rel=1e-12)
        assert abs(out[i]["c"] - float(exact("cov", pairs))) <= 1e-12 * var * 10
        assert out[i]["m"] == pytest.approx(float(exact("mean", pairs)), rel=1e-15)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sliding_frame_in_the_plan(spark):
    df = spark.createDataFrame([("A", 1, 1, 1.0, 2.0, 3)], SCHEMA)
    plan = plan_of(with_rolling(df, Axis().window(), a=Rolling("std", "x", 500), b=Rolling("max", "y", 500), c=Rolling("cov", "x", 500, y="y")))
    frames = re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), ([^)]+\)?)", plan)
    assert frames and all(a.startswith("unboundedpreceding") or a == b.rstrip(")") for a, b in frames), frames
    assert plan.count("Exchange hashpartitioning") == 1


def test_rolling_rejects_what_it_cannot_do():
    for bad in (dict(kind="median", x="x", n=3), dict(kind="cov", x="x", n=3), dict(kind="mean", x="x", n=3, y="y"), dict(kind="sum", x="x", n=0), dict(kind="sum", x="x", n=1, skip=-1)):
        with pytest.raises(ValueError):
            Rolling(**bad)


def test_count_below():
    rng = np.random.default_rng(2)
    for top in (1, 2, 7, 900):
        keys = rng.integers(0, top, 300)
        first = rng.integers(0, 300, 200)
        end = first + rng.integers(0, 300 - first + 1)
        bound = rng.integers(0, top + 1, 200)
        assert count_below(keys, first, end, bound).tolist() == [int((keys[a:b] < c).sum()) for a, b, c in zip(first, end, bound)]


def test_trailing_ranks_equal_counting():
    rng = random.Random(8)
    for n in (1, 2, 9, 500):
        x = [None if rng.random() < 0.2 else rng.choice([1.0, -0.0, 0.0, rng.random()]) for _ in range(300)]
        got = trailing_ranks(pa.chunked_array([pa.array(x[:100], pa.float64()), pa.array(x[100:], pa.float64())]), n).to_pylist()
        for i, v in enumerate(x):
            seen = [a for a in x[max(0, i - n + 1) : i + 1] if a is not None]
            want = None if v is None else (sum(a < v for a in seen) + (sum(a == v for a in seen) + 1) / 2) / len(seen)
            assert got[i] == want
    assert trailing_ranks(pa.chunked_array([pa.array([None, None], pa.float64())]), 3).to_pylist() == [None, None]


def test_trailing_ranks_cost_the_same_for_any_frame():
    x = pa.chunked_array([pa.array(np.random.default_rng(1).random(100_000))])
    took = {}
    for n in (20, 10_000):
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            trailing_ranks(x, n)
            runs.append(time.perf_counter() - start)
        took[n] = min(runs)
    assert took[10_000] < 3 * took[20]


@pytest.mark.parametrize("rows_per_task", [500_000, 30])
def test_rolling_ranks_equal_the_expression(table, rows_per_task):
    new = normalize_features(table, ["x", "k"], Axis(rows_per_task=rows_per_task), "rank", 25, suffix="_rank")
    old = over_rows(table, Axis(), lambda d, w: d.withColumns({f"{c}_rank": rolling_rank(c, w, 25) for c in ("x", "k")}), back=24)
    rows = lambda d: sorted(map(str, d.select("symbol", "seq", "ts", "x_rank", "k_rank").collect()))
    assert rows(new) == rows(old)


@pytest.mark.parametrize("rows_per_task", [1, 3, 50])
def test_ranks_of_values_in_many_cuts(spark, rows_per_task):
    """A third of all rows share a value, so it fills whole cuts and ends inside others."""
    rng = random.Random(4)
    rows = [(s, i, i, rng.choice([5.0, rng.randint(0, 9) / 2, None, rng.random()]), 1.0, 0) for s, n in (("A", 200), ("B", 7), ("C", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    split = {(r["symbol"], r["seq"]): (r["rx"], r["ry"]) for r in average_rank(df, Axis(rows_per_task=rows_per_task), rx="x", ry="y").collect()}
    plain = {(r["symbol"], r["seq"]): (r["rx"], r["ry"]) for r in average_rank(df, Axis(), rx="x", ry="y").collect()}
    assert split == plain and len(plain) == len(rows)


def test_ranks_of_large_keys_join_no_values(spark, table):
    axis = Axis(rows_per_task=40).measured(table)
    plan = plan_of(average_rank(table, axis, rx="x"))
    # rows meet a table with one row per cut, which is small enough to be broadcast; they are dealt out once, by cut
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert sum("_cut" in keys for keys in dealt) == 1
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("lags", [0, 1, 4])
@pytest.mark.parametrize("rows_per_task", [500_000, 9])
def test_gram_matrix_from_lagged_products(spark, lags, rows_per_task):
    rng = np.random.default_rng(9)
    walks = {"A": np.cumsum(rng.normal(size=60)) + 100, "B": rng.normal(size=13)}
    rows = [(s, i, i, float(v), None, 0) for s, x in walks.items() for i, v in enumerate(x)]
    out = models.lagged_products(spark.createDataFrame(rows, SCHEMA), Axis(rows_per_task=rows_per_task), "x", 4).collect()
    for r in out:
        x = walks[r["symbol"]]
        d = np.diff(x)
        design = np.array([[1, x[t], *[d[t - k] for k in range(1, lags + 1)], d[t]] for t in range(lags, len(d))])
        got = models.gram_of_lags(*[r[c] for c in ("n", "sx", "sxx", "xd0", "dd", "xd", "head", "tail")], lags)
        assert np.allclose(got, design.T @ design, rtol=1e-10, atol=1e-8)


def test_nested_residuals():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[:, 3] = x[:, 2]  # adds nothing
    y = x @ rng.normal(size=6) + rng.normal(size=40)
    g = np.column_stack((x, y)).T @ np.column_stack((x, y))
    want = [np.sum((y - x[:, :k] @ np.linalg.lstsq(x[:, :k], y, rcond=None)[0]) ** 2) for k in range(2, 7)]
    assert np.allclose(models.nested_residuals(g, 2), want)


def test_unit_root_rows_carry_no_arrays(spark):
    df = spark.createDataFrame([("A", i, i, float(i % 7), None, 0) for i in range(50)], SCHEMA)
    plan = plan_of(models.unit_root(df, Axis().measured(df), "x"))
    assert "MapInPandas" not in plan and "FlatMapGroups" not in plan and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("parts", [50, 2_000])
def test_quantiles_of_large_keys_from_brackets(spark, monkeypatch, parts):
    """Hot values, missing values, a key without any and brackets much smaller than a key."""
    monkeypatch.setattr(ranking, "SKETCH_PARTS", parts)
    rng = random.Random(6)
    rows = [("A", i, i, rng.choice([5.0, rng.gauss(0, 1), None]), 1.0, i % 7) for i in range(4000)] + [("B", i, i, float(i), None, 0) for i in range(9)] + [("C", 0, 0, None, 2.0, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    probs = [0.0, 0.001, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    for x in ("x", "y", "k"):
        split = {r["symbol"]: r["q"] for r in quantiles(df, Axis(rows_per_task=2_000), x, probs).collect()}
        plain = {r["symbol"]: r["q"] for r in quantiles(df, Axis(), x, probs).collect()}
        assert set(split) == set(plain)
        for symbol, want in plain.items():
            assert split[symbol] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_quantiles_shuffle_their_brackets_only(spark):
    df = spark.range(200_000).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.rand(5).alias("x"))
    axis = Axis(rows_per_task=20_000).measured(df)
    inside = ranking._bracketed(df, axis, "x", [0.01, 0.5, 0.99])
    assert 0 < inside.count() < 0.02 * 200_000
    assert "rangepartitioning" not in plan_of(quantiles(df, axis, "x", [0.5]))


def test_full_frames_equal_sliding_frames(spark):
    """States of five rows, merged: the same values as frames of twenty, gaps, constant stretches and key starts included."""
    rng = random.Random(8)
    draw = lambda i, gap: None if rng.random() < gap else 0.1 if i % 90 < 30 else rng.gauss(1e4, 1)
    rows = [(s, i, draw(i, 0.01), draw(i, 0.01), rng.choice([-7, 0, 2**40])) for s, n in (("a", 700), ("b", 19), ("c", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double, y double, k long")
    w = Axis(order=("ts",)).window()
    states, values = full_frames(w, 20, 5, sx=("std", "x"), sk=("std", "k"), yx=("slope", "y", "x"), yk=("slope", "y", "k"))
    found = df.withColumns(states).withColumns(values)
    found = found.withColumns({"sx_": rolling_std("x", w, 20), "sk_": rolling_std("k", w, 20), "yx_": kyle_lambda("y", "x", w), "yk_": kyle_lambda("y", "k", w)})
    seen = [[(r[c], r[f"{c}_"]) for r in found.collect()] for c in ("sx", "sk", "yx", "yk")]
    for pairs in seen:
        assert [a is None for a, _ in pairs] == [b is None for _, b in pairs] and sum(a is not None for a, _ in pairs) > 200
        assert all(a == pytest.approx(b, rel=1e-9, abs=1e-12) for a, b in pairs if a is not None)
    assert any(a == 0 for a, _ in seen[0]) and all((a == 0) == (b == 0) for a, b in seen[0] if a is not None)
    assert sum(a is not None for a, _ in seen[2]) < sum(a is not None for a, _ in seen[0])
    with pytest.raises(ValueError, match="whole steps"):
        full_frames(w, 20, 6, sx=("std", "x"))
    with pytest.raises(ValueError, match="unknown value"):
        full_frames(w, 20, 5, sx=("mean", "x"))


def test_features_slide_over_few_rows(spark, folder):
    """A sliding frame adds up all its rows again for each row, so the features have none of twenty."""
    ticks = spark.read.parquet(f"{folder}/events.parquet").selectExpr(
        "event_type AS symbol", "ts", "event_id AS seq", "value AS bid_price", "value + 1 AS ask_price", "user_id AS bid_size", "user_id AS ask_size", "value AS trade_price", "user_id AS volume"
    )
    plan = features.lagged_feature_table(ticks, Axis(rows_per_task=400))._jdf.queryExecution().optimizedPlan().toString()
    starts = {int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, (-\d+), currentrow", plan)}
    assert starts and min(starts) > -10
