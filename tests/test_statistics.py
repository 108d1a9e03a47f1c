"""Grouped statistics against straightforward single-series computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kurt_corrected, skew_corrected, student_p, unit_root_p
from tickloom.operators import models, normalize, stats
from tickloom.plans import Axis


@pytest.fixture(scope="module")
def walks(spark):
    """Three series: a random walk, white noise and an autoregression, with their pandas frame."""
    rng = np.random.default_rng(3)
    n = 400
    noise = rng.normal(size=n)
    ar = np.zeros(n)
    for t in range(2, n):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + rng.normal()
    data = {"walk": 100 + np.cumsum(rng.normal(size=n)), "noise": noise, "ar": ar, "short": noise[:40]}
    pdf = pd.concat(
        [pd.DataFrame({"symbol": k, "seq": np.arange(len(v)), "x": v, "y": np.roll(v, -1) + rng.normal(size=len(v))}) for k, v in data.items()]
    )
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
    base = F.expr("timestamp_ntz'2024-01-01 00:00:00' + seq * interval 1 minute")
    return df.withColumn("ts", base).cache(), data, pdf


def least_squares(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, float(resid @ resid)


def dickey_fuller(x):
    """Lag choice on the common sample, then one regression on all rows that lag allows."""
    n = len(x)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dx = np.diff(x)

    def design(lag, first):
        ts = range(first, len(dx))
        rows = [[1.0, x[t], *[dx[t - k] for k in range(1, lag + 1)]] for t in ts]
        return np.array(rows), np.array([dx[t] for t in ts])

    scores = []
    for lag in range(top + 1):
        m, y = design(lag, top)
        scores.append((len(y) * math.log(least_squares(m, y)[1]) + 2 * m.shape[1], lag))
    lag = min(scores)[1]
    m, y = design(lag, lag)
    beta, ssr = least_squares(m, y)
    spread = ssr / (len(y) - m.shape[1]) * np.linalg.inv(m.T @ m)[1, 1]
    return beta[1] / math.sqrt(spread), lag


@pytest.mark.parametrize("size", [2_000_000, 90])
def test_unit_root(walks, size):
    df, data, _ = walks
    out = {r.symbol: r for r in models.unit_root(df, Axis(rows_per_task=size), "x").collect()}
    for symbol, x in data.items():
        stat, lag = dickey_fuller(x)
        assert out[symbol].n_lags == lag
        assert out[symbol].adf_stat == pytest.approx(stat, rel=1e-6)
        assert out[symbol].p_value == pytest.approx(unit_root_p(stat))
    assert not out["walk"].stationary and out["noise"].stationary


def test_unit_root_of_a_constant_is_missing(walks):
    df = walks[0].withColumn("c", F.lit(4.0))
    assert all(r.adf_stat is None and r.p_value is None for r in models.unit_root(df, Axis(), "c").collect())


def test_unit_root_p_at_published_critical_values():
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unit_root_p(stat) == pytest.approx(p, abs=2e-3)
    assert unit_root_p(5.0) == 1.0 and unit_root_p(-30.0) == 0.0


def test_student_tail_at_published_values(spark):
    known = [(12.706, 1.0, 0.05), (2.228, 10.0, 0.05), (2.750, 30.0, 0.01), (1.96, 2e7, 0.05), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5)]
    df = spark.createDataFrame(known, "t double, v double, p double").withColumn("q", student_p("t", "v"))
    for r in df.collect():
        assert r.q == pytest.approx(r.p, abs=1e-4)
    odd = spark.createDataFrame([(None, 3.0), (float("inf"), 3.0)], "t double, v double").select(student_p("t", "v").alias("q")).collect()
    assert [r.q for r in odd] == [None, 0.0]


@pytest.mark.parametrize("size", [2_000_000, 64])
def test_autocorrelation(walks, size):
    df, data, _ = walks
    got = {(r.symbol, r.lag): r for r in stats.autocorrelation(df, Axis(rows_per_task=size), "x", 20).collect()}
    for symbol, x in data.items():
        c = x - x.mean()
        for k in range(1, 21):
            assert got[symbol, k].acf == pytest.approx((c[k:] * c[:-k]).mean() / x.var(ddof=1), abs=1e-9)
        assert got[symbol, 0].acf == 1.0 and got[symbol, 3].conf_upper == pytest.approx(1.96 / math.sqrt(len(x)))


@pytest.mark.parametrize("size", [2_000_000, 64])
def test_rank_ic(walks, size):
    df, data, pdf = walks
    gaps = df.withColumn("y", F.when(F.col("seq") % 10 != 3, F.round("y", 1)))
    got = {r.symbol: r for r in stats.rank_ic(gaps, Axis(rows_per_task=size), "x", "y", min_obs=50).collect()}
    assert "short" not in got
    local = gaps.select("symbol", "seq", "x", "y").toPandas().dropna()
    for symbol, part in local.groupby("symbol"):
        if symbol in got:
            want = part.x.rank().corr(part.y.rank())
            assert got[symbol].ic == pytest.approx(want) and got[symbol].n_obs == len(part)
            assert got[symbol].t_stat == pytest.approx(want * math.sqrt(len(part) - 2) / math.sqrt(1 - want**2 + 1e-10))


def test_rank_ic_rounding(walks):
    r = stats.rank_ic(walks[0], Axis(), "x", "y", round_dp=(4, 3, 4)).first()
    assert r.ic == round(r.ic, 4) and r.t_stat == round(r.t_stat, 3)


@pytest.mark.parametrize("size", [2_000_000, 70])
def test_ridge(spark, size):
    rng = np.random.default_rng(5)
    n, p = 300, 4
    x = rng.normal(size=(n, p)) * [1, 10, 0.1, 1] + [100, 0, 5, 0]
    y = x @ [0.5, 0.1, 2.0, 0.0] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, symbol="A", seq=np.arange(n))
    df = spark.createDataFrame(pdf).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + seq * interval 1 second"))
    cut = int(0.7 * n)
    mean, std = x[:cut].mean(0), x[:cut].std(0)
    z = (x - mean) / std
    zc, yc = z[:cut] - z[:cut].mean(0), y[:cut] - y[:cut].mean()
    coef = np.linalg.solve(zc.T @ zc + np.eye(p), zc.T @ yc)
    guess = z[cut:] @ coef + y[:cut].mean()
    r2 = 1 - ((y[cut:] - guess) ** 2).sum() / ((y[cut:] - y[cut:].mean()) ** 2).sum()
    ic = pd.Series(guess).rank().corr(pd.Series(y[cut:]).rank())
    r = models.ridge_baseline(df, list("abcd"), Axis(rows_per_task=size), "y").first()
    assert (r.n_train, r.n_test) == (cut, n - cut)
    assert r.oos_r2 == pytest.approx(r2) and r.oos_ic == pytest.approx(ic)


def test_corrected_moments_and_audit(walks):
    df, data, _ = walks
    got = {r.symbol: r for r in df.groupBy("symbol").agg(skew_corrected("x").alias("s"), kurt_corrected("x").alias("k")).collect()}
    for symbol, x in data.items():
        assert got[symbol].s == pytest.approx(pd.Series(x).skew()) and got[symbol].k == pytest.approx(pd.Series(x).kurt())
    d = normalize.normalize_features(df, ["x"], Axis(), "zscore", suffix="_z")
    after = [r for r in normalize.normalization_audit(d, {"x": ("x", "x_z")}).collect() if r.stage == "after"]
    assert all(abs(r["mean"]) < 1e-9 and abs(r["std"] - 1) < 1e-9 and r.missing == 0 for r in after)


def test_histogram_counts_every_value(walks):
    df, data, _ = walks
    got = stats.histogram(df, Axis(), "x", bins=20).toPandas()
    for symbol, x in data.items():
        part = got[got.symbol == symbol].sort_values("bin")
        want, edges = np.histogram(x, bins=20)
        assert part["count"].tolist() == want.tolist()
        assert np.allclose(part.left_edge, edges[:-1])
        assert np.allclose(part.density, np.histogram(x, bins=20, density=True)[0])


def test_regression(walks):
    df, data, pdf = walks
    got = {r.symbol: r for r in stats.ols(df, "y", "x", ("symbol",)).collect()}
    for symbol, part in pdf.groupby("symbol"):
        m = np.column_stack([np.ones(len(part)), part.x])
        beta, ssr = least_squares(m, part.y.to_numpy())
        assert got[symbol].beta == pytest.approx(beta[1]) and got[symbol].intercept == pytest.approx(beta[0])
        err = math.sqrt(ssr / (len(part) - 2) * np.linalg.inv(m.T @ m)[1, 1])
        assert got[symbol].std_err == pytest.approx(err) and got[symbol].t_stat == pytest.approx(beta[1] / err)
        assert got[symbol].r2 == pytest.approx(1 - ssr / ((part.y - part.y.mean()) ** 2).sum())
    residual = stats.ols_residuals(df, stats.ols(df, "y", "x", ("symbol",)), "y", "x", ("symbol",)).collect()
    assert len(residual) == 4 and all(r.kurtosis > 0 for r in residual)


def test_one_row_key(spark):
    df = spark.sql("SELECT 'A' AS symbol, timestamp_ntz'2024-01-01' AS ts, 0L AS seq, 1.0D AS x")
    assert stats.t_test(df, Axis(), "x").first().p_value is None
    assert stats.moments(df, Axis(), "x").first().std is None
    assert stats.autocorrelation(df, Axis(), "x", 3).filter("lag = 1").first().acf is None
