"""Rank correlations of many columns from two range sorts, against ranks worked out in pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import ArithmeticException

from tickloom.operators import stats
from tickloom.plans import Axis


@pytest.mark.parametrize("rows_per_task", [50, 500_000])
def test_feature_ic_of_ties_gaps_and_large_keys(spark, monkeypatch, rows_per_task):
    _ties_gaps_and_large_keys(spark, monkeypatch, rows_per_task)


@pytest.mark.parametrize("rows_per_task", [50, 500_000])
def test_feature_ic_of_very_many_targets(spark, monkeypatch, rows_per_task):
    """More different targets than may be sent to all tasks: rows are sorted by them."""
    monkeypatch.setattr("tickloom.plans.rankcorr.FEW_TARGETS", 10)
    _ties_gaps_and_large_keys(spark, monkeypatch, rows_per_task)


def _ties_gaps_and_large_keys(spark, monkeypatch, rows_per_task):
    rng = np.random.default_rng(5)
    n = 4_000
    d = pd.DataFrame({"symbol": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "ts": range(n), "seq": range(n)})
    d["same"], d["few"], d["many"], d["zero"] = 1.0, rng.integers(0, 3, n) * 1.0, rng.normal(size=n), np.where(rng.random(n) < 0.5, -0.0, 0.0)
    d["y"] = np.where(rng.random(n) < 0.6, 0.0, d["few"] + rng.normal(size=n))
    d.loc[::17, "many"] = np.nan
    df = spark.createDataFrame(d).repartition(5)
    monkeypatch.setattr("tickloom.plans.rankcorr.ROWS_PER_SORT", 300)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {(r.symbol, r.feature): (r.ic, r.n_obs) for r in stats.feature_ic(df, ["few", "many"], Axis(rows_per_task=rows_per_task), "y").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    whole = d.dropna()
    for symbol, g in whole.groupby("symbol"):
        ranks = g[["few", "many", "y"]].rank()
        for c in ("few", "many"):
            assert got[symbol, c] == (pytest.approx(ranks[c].corr(ranks["y"]), abs=1e-12), len(g))
    for constant in ("same", "zero"):
        with pytest.raises(ArithmeticException):
            stats.feature_ic(df, [constant], Axis(rows_per_task=rows_per_task), "y").collect()


def test_feature_ic_moves_cells_of_distinct_values_only(spark):
    """16 features of few values: cells combine in the tasks, so rows are not unpivoted into the exchange."""
    d = spark.range(20_000).selectExpr("'a' AS symbol", "id AS ts", "id AS seq", "id % 7 AS y", *[f"CAST(id % {k + 2} AS DOUBLE) AS f{k}" for k in range(16)])
    out = stats.feature_ic(d, [f"f{k}" for k in range(16)], Axis(rows_per_task=400), "y")
    assert out.count() == 16 and {r.n_obs for r in out.collect()} == {20_000}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1]


def _written(monkeypatch, run):
    """Tables that ``run`` writes with ``materialise``, as lists of their columns."""
    from tickloom.plans import layout

    found, plain = [], layout.materialise
    def write(df):
        found.append(df.columns)
        return plain(df)

    for module in ("tickloom.plans.rankcorr", "tickloom.plans.layout", "tickloom.plans.ranking", "tickloom.operators.models", "tickloom.catalog.statistics"):
        monkeypatch.setattr(f"{module}.materialise", write)
    run()
    return found


def test_rows_stay_where_they_are_for_targets_of_few_values(spark, monkeypatch):
    d = spark.range(5_000).selectExpr("'a' AS symbol", "id AS ts", "id AS seq", "id % 7 AS y", *[f"CAST(id * 7919 % {k + 900} AS DOUBLE) AS f{k}" for k in range(16)])
    names = [f"f{k}" for k in range(16)]
    written = _written(monkeypatch, lambda: stats.feature_ic(d, names, Axis(rows_per_task=400), "y").collect())
    assert len([w for w in written if len(w) > 16]) == 1  # the rows themselves, before and not after a sort by the target


def test_a_full_run_writes_its_wide_rows_once(spark, folder, monkeypatch):
    from tickloom.catalog import QUERIES

    written = _written(monkeypatch, lambda: QUERIES["checked_full_run"](spark, folder).collect())
    assert len([w for w in written if "kyle_lambda" in w or "_x12" in w]) == 1


def test_the_ridge_report_of_split_keys(spark, folder, monkeypatch):
    """The same scores as with whole keys, and predictions are ranked without numbering their rows twice."""
    from tickloom.operators.features import lagged_feature_table
    from tickloom.operators.models import ridge_baseline
    from tickloom.sources import market_table

    table = lagged_feature_table(market_table(spark, folder, "ticks")).select("symbol", "ts", "seq", "spread", "queue_imbalance", "ret_1m").na.drop("any")
    table = spark.createDataFrame(table.toPandas())
    rows = lambda axis: {r["symbol"]: r for r in ridge_baseline(table, ["spread", "queue_imbalance"], axis).collect()}
    want, got = rows(Axis()), {}
    written = _written(monkeypatch, lambda: got.update(rows(Axis(rows_per_task=40))))
    assert set(got) == set(want) and len(got) > 1
    for k, r in want.items():
        assert got[k]["oos_ic"] == pytest.approx(r["oos_ic"], abs=1e-9) and got[k]["n_test"] == r["n_test"] and got[k]["oos_r2"] == pytest.approx(r["oos_r2"], abs=1e-9)
    assert len([w for w in written if "_y" in w or "prediction" in w]) <= 2
