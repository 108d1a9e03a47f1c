"""A key cut into runs must give exactly what one plain window gives."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import clean
from tickloom.plans import (
    POS, Axis, after, average_rank, before, number_rows, over_rows, quantiles, rolling_rank, rolling_std, rolling_sum,
    running, with_positions,
)




@pytest.fixture(scope="module")
def hot(spark):
    """One key with most of the rows, tied times, missing values, a one-row key, in random order."""
    rng = random.Random(7)
    rows = []
    for symbol, n in (("HOT", 900), ("cool", 150), ("one", 1)):
        for i in range(n):
            us = 1_704_067_200_000_000 + (i // 3) * 700_000
            y = None if rng.random() < 0.1 else rng.choice([0.0, 1.5, rng.random()])
            rows.append((symbol, us, i, rng.randint(-50, 50), y))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "symbol string, us bigint, seq bigint, x bigint, y double")
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return df.select("symbol", F.timestamp_add("MICROSECOND", "us", epoch).alias("ts"), "seq", "x", "y").cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select("symbol", "seq", *columns).collect()), key=str)


@pytest.mark.parametrize("size", [7, 32, 100, 899])
def test_positions(hot, size):
    split = number_rows(hot, Axis(rows_per_task=size))
    plain = with_positions(hot, Axis())
    assert rows_of(split, POS) == rows_of(plain, POS)


@pytest.mark.parametrize("size", [5, 32, 200])
def test_bounded_frames(hot, size):
    def build(d, w):
        d = d.withColumns({"b": before("x", w, 3), "a": after("x", w, 4), "s": rolling_sum("x", w, 20)})
        return d.withColumns({"ss": rolling_sum("s", w, 5), "r": rolling_rank("y", w, 10)})

    names = ["b", "a", "s", "ss", "r"]
    split = over_rows(hot, Axis(rows_per_task=size), build, back=24, ahead=4)
    plain = over_rows(hot, Axis(), build, back=24, ahead=4)
    assert set(split.columns) == set(plain.columns)
    assert rows_of(split, *names) == rows_of(plain, *names)


@pytest.mark.parametrize("size", [5, 64])
def test_running_values(hot, size):
    specs = dict(
        total=("sum", "x"), low=("min", "y"), high=("max", "y"), known=("last", "y"), twos=("product", F.lit(1.0)),
    )
    split, plain = running(hot, Axis(rows_per_task=size), **specs), running(hot, Axis(), **specs)
    assert rows_of(split, *specs) == rows_of(plain, *specs)


@pytest.mark.parametrize("size", [5, 64])
def test_ranks_and_quantiles(hot, size):
    split = average_rank(hot, Axis(rows_per_task=size), rx="x", ry="y")
    plain = average_rank(hot, Axis(), rx="x", ry="y")
    assert rows_of(split, "x", "y", "rx", "ry") == rows_of(plain, "x", "y", "rx", "ry")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r.symbol: r.q for r in quantiles(hot, Axis(rows_per_task=size), "y", probs).collect()}
    want = {r.symbol: r.q for r in quantiles(hot, Axis(), "y", probs).collect()}
    assert set(got) == set(want)
    for symbol in want:
        if want[symbol] is not None:
            assert got[symbol] == pytest.approx(want[symbol], abs=1e-12)


def test_ranks_match_pandas(hot):
    pdf = hot.toPandas()
    want = dict(zip(zip(pdf.symbol, pdf.seq), pdf.groupby("symbol").y.rank()))
    for row in average_rank(hot, Axis(), ry="y").collect():
        expected = want[row.symbol, row.seq]
        assert (row.ry is None and expected != expected) or row.ry == expected


def test_split_grid_equals_plain_grid(hot):
    unique = clean.first_arrivals(hot)
    split = clean.regular_grid(unique, Axis(rows_per_task=40), "1 second")
    plain = clean.regular_grid(unique, Axis(), "1 second")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(split) == key(plain)


def test_grid_segments_cover_long_gaps(spark, monkeypatch):
    monkeypatch.setattr(clean, "GRID_SEGMENT", 10)
    df = spark.sql(
        "SELECT 'a' AS symbol, ts, seq, seq * 1.0D AS price FROM VALUES (timestamp_ntz'2024-01-01 00:00:00', 0L), (timestamp_ntz'2024-01-01 00:01:37.5', 1L), (timestamp_ntz'2024-01-01 00:01:40', 2L) AS t(ts, seq)"
    )
    grid = [(r.ts.minute * 60 + r.ts.second, r.price) for r in clean.regular_grid(df).orderBy("ts").collect()]
    assert grid == [(s, 0.0) for s in range(98)] + [(98, 1.0), (99, 1.0), (100, 2.0)]


def test_row_order_never_matters(hot):
    shuffled = hot.orderBy(F.xxhash64("seq", "symbol"))
    build = lambda d, w: d.withColumn("s", rolling_std("x", w, 9))
    assert rows_of(over_rows(hot, Axis(), build, back=8), "s") == rows_of(over_rows(shuffled, Axis(), build, back=8), "s")


def test_small_keys_use_one_shuffle(hot):
    axis = Axis().measured(hot)
    df = over_rows(hot, axis, lambda d, w: d.withColumn("s", rolling_sum("x", w, 9)), back=8)
    df = running(df, axis, total=("sum", "x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_measured_axis_is_kept(hot):
    axis = Axis().measured(hot)
    assert (axis.widest, axis.n_keys) == (900, 3)
    assert axis.measured(hot.limit(0)) is axis
    with pytest.raises(ValueError):
        Axis(keys=())
