"""Descriptions, tests, correlations, autocorrelation, information coefficients, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, models, ofi, stats, validate
from ..plans import Axis, materialise, quantiles
from ..sources import read_parquet, write_parquet
from .base import W, WD, over, query, r, rounded, student_tail, table
from .cleaning_and_bars import SIGNALS, ofi_signals
from .selection import RET, SIZE_OFI, _scratch, daily_returns
from .tables_and_targets import INVARIANTS, LAGGED_STEPS, WHOLE_STEPS

PAIR = """SELECT a.date, a.ret AS x, b.ret AS y FROM (SELECT * FROM x WHERE symbol = '1-URGENT') a
FULL JOIN (SELECT * FROM x WHERE symbol = '2-HIGH') b ON a.date = b.date"""
MOMENTS = """SELECT symbol, count(ret) AS n, avg(ret) AS m, avg(pow(ret - mu, 2)) AS m2, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4
FROM x JOIN (SELECT symbol, avg(ret) AS mu FROM x GROUP BY symbol) USING (symbol) GROUP BY symbol"""


@query(over("daily", f"""
SELECT symbol, {r('max(ret)')} AS best, {r('min(ret)')} AS worst, {r('avg(ret)')} AS mean, {r('var_pop(ret)')} AS variance, {r('stddev_pop(ret)')} AS std,
       {r('100.0 * count(*) FILTER (ret > 0) / count(ret)')} AS win_rate FROM x GROUP BY symbol""", x=RET))
def return_summary(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.return_summary(df, axis))


@query(over("daily", f"""
SELECT symbol, n AS nobs, {r('lo')} AS min, {r('hi')} AS max, {r('m')} AS mean, {r('v')} AS variance, {r('sqrt(v)')} AS std,
       {r('m3 / pow(m2, 1.5)', 5)} AS skewness, {r('m4 / (m2 * m2) - 3', 4)} AS kurtosis
FROM mo JOIN (SELECT symbol, min(ret) AS lo, max(ret) AS hi, var_samp(ret) AS v FROM x GROUP BY symbol) USING (symbol)""", x=RET, mo=MOMENTS))
def return_moments(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.moments(df, axis), skewness=5, kurtosis=4)


def _described(c: str) -> str:
    return f"""SELECT symbol, '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
{r(f'CAST(min({c}) AS DOUBLE)')} AS min, {r(f'quantile_cont({c}, 0.25)')} AS p25, {r(f'quantile_cont({c}, 0.5)')} AS p50, {r(f'quantile_cont({c}, 0.75)')} AS p75,
{r(f'CAST(max({c}) AS DOUBLE)')} AS max FROM (SELECT symbol, CAST({c} AS DOUBLE) AS {c} FROM ticks) GROUP BY symbol"""


@query(over("ticks", " UNION ALL ".join(map(_described, ("trade_price", "volume", "bid_size")))))
def table_description(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(stats.describe_table(df, ["trade_price", "volume", "bid_size"], axis))


@query(over("ticks", " UNION ALL ".join(map(_described, ("trade_price", "volume")))))
def split_key_description(spark, folder):
    df, axis = table(spark, folder, "ticks", Axis(rows_per_task=500))
    return rounded(stats.describe_table(df, ["trade_price", "volume"], axis))


@query(over("dirty", """
SELECT count(*) FILTER (symbol IS NULL) AS symbol, count(*) FILTER (ts IS NULL) AS ts, count(*) FILTER (seq IS NULL) AS seq,
       count(*) FILTER (price IS NULL) AS price, count(*) FILTER (volume IS NULL) AS volume, count(*) FILTER (price IS NULL) AS total_missing FROM dirty"""))
def missing_values(spark, folder):
    return stats.missing_counts(table(spark, folder, "dirty")[0])


@query(over("dirty", "SELECT count(*) AS rows, 5 AS columns, 'symbol,ts,seq,price,volume' AS names FROM dirty"))
def table_shape(spark, folder):
    return stats.shape(table(spark, folder, "dirty")[0])


@query(over("ticks", f"""
SELECT symbol, {r('quantile_cont(ofi, 0.01)')} AS p01, {r('quantile_cont(ofi, 0.99)')} AS p99 FROM (SELECT symbol, CAST(ofi AS DOUBLE) AS ofi FROM x) GROUP BY symbol""", x=SIZE_OFI))
def tail_quantiles(spark, folder):
    df, axis = table(spark, folder, "ticks")
    q = quantiles(ofi.with_ofi(df, axis, "size_only"), axis, "ofi", [0.01, 0.99])
    return rounded(q.select("symbol", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p99")))


@query(over("daily", f"""
SELECT symbol, CAST(i AS INTEGER) AS bin, coalesce(c, 0) AS count, {r('lo + i * w')} AS left_edge, {r('coalesce(c, 0) / (n * w)')} AS density
FROM (SELECT *, unnest(range(50)) AS i FROM e) LEFT JOIN
     (SELECT symbol, least(CAST(floor((ret - lo) / w) AS BIGINT), 49) AS i, count(*) AS c FROM x JOIN e USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL)
     USING (symbol, i)""", x=RET, e="SELECT symbol, min(ret) AS lo, (max(ret) - min(ret)) / 50.0 AS w, count(ret) AS n FROM x GROUP BY symbol"))
def return_histogram(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.histogram(df, axis))


@query(over("daily", f"""
SELECT symbol, CAST(i AS INTEGER) AS point, {r('p')} AS x, {r('exp(-pow((p - m) / s, 2) / 2) / (s * sqrt(2 * pi()))')} AS density
FROM (SELECT *, lo + (hi - lo) * i / 99 AS p FROM (SELECT *, unnest(range(100)) AS i FROM e))""", x=RET,
    e="SELECT symbol, min(ret) AS lo, max(ret) AS hi, avg(ret) AS m, stddev_samp(ret) AS s FROM x GROUP BY symbol"))
def normal_curve(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.normal_curve(df, axis))


def _pair(spark, folder):
    df, _ = daily_returns(spark, folder)
    return stats.pair_table(df, "1-URGENT", "2-HIGH", value="ret").withColumnsRenamed({"left": "x", "right": "y"})


@query(over("daily", f"SELECT {r('corr(x, y)')} AS corr, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL", x=RET, p=PAIR))
def return_correlation(spark, folder):
    return rounded(stats.correlation(_pair(spark, folder), "x", "y"))


OLS = {
    "x": RET, "p": PAIR,
    "f": """SELECT regr_slope(y, x) AS beta, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS n,
sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS std_err
FROM p WHERE x IS NOT NULL AND y IS NOT NULL""",
}


@query(over("daily", f"""
SELECT {r('beta')} AS beta, {r('intercept')} AS intercept, {r('r2')} AS r2, n, {r('std_err')} AS std_err, {r('beta / std_err')} AS t_stat,
       {r(student_tail('(beta / std_err)', '(n - 2)'))} AS p_value FROM f""", **OLS))
def market_regression(spark, folder):
    return rounded(stats.ols(_pair(spark, folder), "y", "x"))


@query(over("daily", f"""
SELECT n, {r('s', 5)} AS skewness, {r('k', 4)} AS kurtosis, {r('n / 6.0 * (s * s + pow(k - 3, 2) / 4)', 2)} AS jarque_bera, {r('exp(-n / 12.0 * (s * s + pow(k - 3, 2) / 4))', 4)} AS jb_p_value
FROM (SELECT count(*) AS n, avg(pow(e - mu, 3)) / pow(avg(pow(e - mu, 2)), 1.5) AS s, avg(pow(e - mu, 4)) / pow(avg(pow(e - mu, 2)), 2) AS k
      FROM e, (SELECT avg(e) AS mu FROM e))""", **OLS, e="SELECT y - intercept - beta * x AS e FROM p, f WHERE x IS NOT NULL AND y IS NOT NULL"))
def regression_residuals(spark, folder):
    pair = _pair(spark, folder)
    report = stats.ols_residuals(pair, stats.ols(pair, "y", "x"), "y", "x")
    return rounded(report, skewness=5, kurtosis=4, jarque_bera=2, jb_p_value=4)


@query(over("daily", f"""
SELECT symbol, {r('m')} AS mean, n, {r('m / (s / sqrt(n))')} AS t_stat, {r(student_tail('(m / (s / sqrt(n)))', '(n - 1)'))} AS p_value,
       {student_tail('(m / (s / sqrt(n)))', '(n - 1)')} < 0.05 AS reject
FROM (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, count(ret) AS n FROM x GROUP BY symbol)""", x=RET))
def mean_return_test(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.t_test(df, axis))


STRATEGY_P = f"""SELECT strategy_id, {student_tail('(m / (s / sqrt(n)))', '(n - 1)')} AS p FROM
(SELECT strategy_id, avg(ret) AS m, stddev_samp(ret) AS s, count(ret) AS n FROM strategies GROUP BY strategy_id)"""
STRATEGY_AXIS = Axis(("strategy_id",), ("obs_id",))


@query(over("strategies", f"SELECT strategy_id, {r('p')} AS p_value, p < 0.05 AS reject FROM t", t=STRATEGY_P))
def strategy_tests(spark, folder):
    df, axis = table(spark, folder, "strategies", STRATEGY_AXIS)
    return rounded(stats.t_test(df, axis).select("strategy_id", "p_value", "reject"))


@query(over("strategies", f"""
SELECT count(*) AS n_tests, count(*) FILTER (p < 0.05) AS significant_before, {r('0.05 / count(*)')} AS threshold,
       count(*) FILTER (p < 0.05 / (SELECT count(*) FROM t)) AS significant_after FROM t""", t=STRATEGY_P))
def bonferroni_correction(spark, folder):
    df, axis = table(spark, folder, "strategies", STRATEGY_AXIS)
    return rounded(stats.bonferroni(stats.t_test(df, axis)))


NORMALITY = {
    "x": RET, "mo": MOMENTS,
    "a": "SELECT symbol, CAST(n AS DOUBLE) AS n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) AS k FROM mo",
    "b": """SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
(k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS z,
6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM a""",
    "c": "SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS aa FROM b",
    "d": """SELECT symbol, n, s, k - 3 AS k, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
(1 - 2 / (9 * aa) - sign(1 + z * sqrt(2 / (aa - 4))) * cbrt((1 - 2 / aa) / abs(1 + z * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS zk FROM c""",
}


@query(over("daily", f"""
SELECT symbol, CAST(n AS BIGINT) AS n, {r('s', 5)} AS skewness, {r('k', 4)} AS kurtosis, {r('zs * zs + zk * zk', 4)} AS k2, {r('exp(-(zs * zs + zk * zk) / 2)')} AS p_value FROM d""", **NORMALITY))
def return_normality(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(stats.normality(df, axis), skewness=5, kurtosis=4, k2=4)


HB = "(PARTITION BY symbol, horizon ORDER BY bar_start)"
ACF = SIGNALS | {
    "ce": "SELECT symbol, horizon, bar_start, ofi - avg(ofi) OVER (PARTITION BY symbol, horizon) AS c FROM g",
    "pr": f"SELECT *, {', '.join(f'c * lag(c, {k}) OVER {HB} AS k{k}' for k in range(1, 21))} FROM ce",
    "ac": " UNION ALL ".join(
        ["SELECT symbol, horizon, 0 AS lag, 1.0::DOUBLE AS acf, 1.96 / sqrt(count(*)) AS band FROM pr GROUP BY ALL"]
        + [f"SELECT symbol, horizon, {k} AS lag, avg(k{k}) / var_samp(c) AS acf, 1.96 / sqrt(count(*)) AS band FROM pr GROUP BY ALL" for k in range(1, 21)]
    ),
}


@query(over("ticks", f"SELECT symbol, horizon, lag, {r('acf')} AS acf, {r('band')} AS conf_upper, {r('-band')} AS conf_lower FROM ac", **ACF))
def ofi_autocorrelation(spark, folder):
    d, axis = ofi_signals(spark, folder)
    return rounded(stats.autocorrelation(d, axis))


@query(over("ticks", f"SELECT symbol, horizon, lag, {r('acf')} AS acf FROM ac WHERE abs(acf) > band AND lag > 0", **ACF))
def significant_ofi_lags(spark, folder):
    d, axis = ofi_signals(spark, folder)
    return rounded(stats.significant_lags(stats.autocorrelation(d, axis)).select("symbol", "horizon", "lag", "acf"))


def avg_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


IC = SIGNALS | {
    "rk": f"SELECT symbol, horizon, {avg_rank('ofi_lag1', 'symbol, horizon')} AS rx, {avg_rank('forward_return', 'symbol, horizon')} AS ry FROM g",
    "ic": "SELECT symbol, horizon, corr(rx, ry) AS ic, count(*) AS n FROM rk GROUP BY symbol, horizon HAVING count(*) >= 30",
}


@query(over("ticks", f"""
SELECT symbol, horizon, {r('ic')} AS ic, n AS n_obs, {r('ic * sqrt(n - 2) / sqrt(1 - ic * ic + 1e-10)')} AS t_stat,
       {r(student_tail('(ic * sqrt((n - 2) / (1 - ic * ic)))', '(n - 2)'))} AS p_value,
       {student_tail('(ic * sqrt((n - 2) / (1 - ic * ic)))', '(n - 2)')} < 0.05 AS significant FROM ic""", **IC))
def ofi_information_coefficient(spark, folder):
    d, axis = ofi_signals(spark, folder)
    return rounded(stats.rank_ic(d, axis, min_obs=30))


@query(over("ticks", f"""
SELECT symbol, {r('corr(rx, ry)')} AS ic, count(*) AS n_obs FROM (SELECT symbol, {avg_rank('ofi', 'symbol')} AS rx, {avg_rank('f', 'symbol')} AS ry
FROM (SELECT *, lead(mi) OVER {W} / mi - 1 AS f FROM (SELECT *, (bid_price + ask_price) / 2 AS mi FROM x)) WHERE ofi IS NOT NULL AND f IS NOT NULL) GROUP BY symbol""", x=SIZE_OFI))
def tick_information_coefficient(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_ofi(df, axis, "size_only").withColumn("mid", (F.col("bid_price") + F.col("ask_price")) / 2)
    d = features.forward_return(d, axis, price="mid")
    return rounded(stats.rank_ic(d, axis, "ofi", "forward_return").select("symbol", "ic", "n_obs"))


_IC = " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS feature, {r('corr(rx, ry)', 4)} AS ic, count(*) AS n_obs FROM (SELECT symbol, {avg_rank(f'round({c}, 12)', 'symbol')} AS rx, {avg_rank('round(ret_1m, 12)', 'symbol')} AS ry FROM whole) GROUP BY symbol"
    for c in features.FEATURES
)


@query(over("ticks", _IC, **WHOLE_STEPS))
def feature_information_coefficients(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.lagged_feature_table(df, axis)
    # values equal up to the last bits must tie in every engine
    d = d.withColumns({c: F.round(c, 12) for c in (*features.FEATURES, "ret_1m")})
    return rounded(stats.feature_ic(d, list(features.FEATURES), axis), 4)


@query(over("ticks", _IC, **WHOLE_STEPS))
def split_key_feature_ic(spark, folder):
    """The same on keys of which none fits in one task: ranks come from range sorts cut into pieces."""
    df, axis = table(spark, folder, "ticks", Axis(rows_per_task=400))
    d = features.lagged_feature_table(df, axis)
    d = d.withColumns({c: F.round(c, 12) for c in (*features.FEATURES, "ret_1m")})
    return rounded(stats.feature_ic(d, list(features.FEATURES), axis), 4)


@query()
def ofi_unit_root(spark, folder):
    d, axis = ofi_signals(spark, folder)
    return rounded(models.unit_root(d, axis), 4)


DF = f"""SELECT symbol, regr_slope(d, l) AS b, sqrt((regr_syy(d, l) - pow(regr_sxy(d, l), 2) / regr_sxx(d, l)) / (count(d) - 2) / regr_sxx(d, l)) AS se
FROM (SELECT symbol, close - lag(close) OVER {WD} AS d, lag(close) OVER {WD} AS l FROM daily) WHERE d IS NOT NULL GROUP BY symbol"""


@query(over("daily", f"SELECT symbol, {r('b / se', 4)} AS adf_stat, 0 AS n_lags FROM f", f=DF))
def unit_root_without_lags(spark, folder):
    df, axis = table(spark, folder, "daily")
    return rounded(models.unit_root(df, axis, "close", max_lag=0).select("symbol", "adf_stat", "n_lags"), 4)


def adf_sql(k: int, known: str) -> str:
    """Regression of the change on a constant, ``k`` earlier changes and the level, by taking out one column after another."""
    changes = [f"d{i}" for i in range(1, k + 1)]
    sql = f"SELECT symbol, {', '.join(f'{c} - avg({c}) OVER s AS {c}' for c in [*changes, 'l', 'd'])} FROM moves WHERE {known} IS NOT NULL WINDOW s AS (PARTITION BY symbol)"
    for i, c in enumerate(changes):
        rest = [*changes[i + 1 :], "l", "d"]
        sql = f"SELECT symbol, {', '.join(f'{x} - {c} * sum({x} * {c}) OVER s / sum({c} * {c}) OVER s AS {x}' for x in rest)} FROM ({sql}) WINDOW s AS (PARTITION BY symbol)"
    return f"SELECT symbol, {k} AS k, count(*) AS n, sum(l * d) / sum(l * l) AS b, sum(d * d) - pow(sum(l * d), 2) / sum(l * l) AS ssr, sum(l * l) AS ll FROM ({sql}) GROUP BY symbol"


def moves_sql(series: str, x: str, n_lags: int) -> str:
    diff = lambda k: f"lag({x}, {k}) OVER {WD} - lag({x}, {k + 1}) OVER {WD}" if k else f"{x} - lag({x}) OVER {WD}"
    return f"SELECT symbol, lag({x}) OVER {WD} AS l, {diff(0)} AS d, {', '.join(f'{diff(k)} AS d{k}' for k in range(1, n_lags + 1))} FROM {series}"


@query(over("daily", f"SELECT symbol, {r('b / sqrt(ssr / (n - k - 2) / ll)', 4)} AS adf_stat, CAST(k AS INTEGER) AS n_lags FROM f", moves=moves_sql("daily", "close", 2), f=adf_sql(2, "d2")))
def unit_root_two_lags(spark, folder):
    df, axis = table(spark, folder, "daily")
    return rounded(models.unit_root(df, axis, "close", max_lag=2, autolag=False).select("symbol", "adf_stat", "n_lags"), 4)


@query(over("daily", f"""
SELECT symbol, {r('b / sqrt(ssr / (n - k - 2) / ll)', 4)} AS adf_stat, CAST(k AS INTEGER) AS n_lags
FROM (SELECT symbol, arg_min(k, n * ln(ssr) + 2 * (2 + k)) AS k FROM tried GROUP BY symbol) JOIN own USING (symbol, k)""",
    x=RET, kept="SELECT * FROM x WHERE ret IS NOT NULL", moves=moves_sql("kept", "ret", 2),
    tried=" UNION ALL ".join(adf_sql(k, "d2") for k in range(3)), own=" UNION ALL ".join(adf_sql(k, f"d{k}" if k else "d") for k in range(3))))
def unit_root_lags_by_aic(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(models.unit_root(df, axis, "ret", max_lag=2).select("symbol", "adf_stat", "n_lags"), 4)


@query()
def price_and_return_unit_roots(spark, folder):
    df, axis = daily_returns(spark, folder)
    both = models.unit_root(df, axis, "close").withColumn("series", F.lit("price")).unionByName(
        models.unit_root(df, axis, "ret").withColumn("series", F.lit("return"))
    )
    return rounded(both, 4)


_BROKEN = " UNION ALL ".join(f"SELECT symbol, {v} AS violations FROM lagged GROUP BY symbol" for v in INVARIANTS.values())


@query(over("ticks", f"""
SELECT symbol, feature, ic, n_obs, violations, violations = 0 AS passed FROM ({_IC})
JOIN (SELECT symbol, CAST(sum(violations) AS BIGINT) AS violations FROM ({_BROKEN}) GROUP BY symbol) USING (symbol)""", **(LAGGED_STEPS | WHOLE_STEPS)))
def feature_pipeline(spark, folder):
    """Features, targets and lags once; their invariants; the rank IC of each feature, with the violations of its symbol."""
    df, axis = table(spark, folder, "ticks")
    lagged = materialise(features.lagged_feature_table(df, axis))
    broken = validate.feature_invariants(lagged, axis).groupBy("symbol").agg(F.sum("violations").alias("violations"))
    d = lagged.withColumns({c: F.round(c, 12) for c in (*features.FEATURES, "ret_1m")})
    ic = rounded(stats.feature_ic(d, list(features.FEATURES), axis), 4)
    return ic.join(broken, "symbol").withColumn("passed", F.col("violations") == 0)


def eliminated(columns: list[str], target: str, carried: str, source: str) -> dict[str, str]:
    """Steps to ``left``: ``target`` less its regression on the columns over the rows that ``fit`` marks, for all rows.

    One column after another is taken out of those that follow, with sums per symbol over the marked rows.
    """
    steps = {}
    for i, c in enumerate(columns):
        out = ", ".join(f"{x} - {c} * sum({x} * {c}) FILTER (fit) OVER s / sum({c} * {c}) FILTER (fit) OVER s AS {x}" for x in [*columns[i + 1 :], target])
        steps[f"less{i + 1}"] = f"SELECT symbol, fit, {carried}, {out} FROM {source if i == 0 else f'less{i}'} WINDOW s AS (PARTITION BY symbol)"
    return steps


_F = list(features.FEATURES)
#: A penalty of one is a row for each feature that holds one there and nothing else.
RIDGE16 = WHOLE_STEPS | {
    "cut": f"""SELECT symbol, {', '.join(f'round({c}, 12)::DOUBLE AS {c}' for c in [*_F, 'ret_1m'])}, row_number() OVER {W} <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM whole""",
    "fitted": f"SELECT symbol, {', '.join(f'avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}' for c in _F)}, avg(ret_1m) AS my, count(*) AS n_train FROM cut WHERE is_train GROUP BY symbol",
    "scaled": f"""SELECT symbol, is_train AS fit, NOT is_train AS test, ret_1m AS y, ret_1m - my AS e, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in _F)} FROM cut JOIN fitted USING (symbol)
UNION ALL SELECT symbol, true, false, 0, 0, {', '.join(f'CASE WHEN i = {i} THEN 1 ELSE 0 END' for i in range(len(_F)))} FROM fitted, generate_series(0, {len(_F) - 1}) AS g(i)""",
    **eliminated(_F, "e", "test, y", "scaled"),
    "tested": f"SELECT symbol, y, e, y - e AS yhat FROM less{len(_F)} WHERE test",
    "ranks": f"SELECT *, {avg_rank('round(yhat, 13)', 'symbol')} AS rx, {avg_rank('y', 'symbol')} AS ry FROM tested",
}


@query(over("ticks", f"""
SELECT symbol, {r('corr(rx, ry)', 4)} AS oos_ic, {r('1 - sum(e * e) / (var_pop(y) * count(y))', 4)} AS oos_r2, n_train, count(*) AS n_test
FROM ranks JOIN (SELECT symbol, n_train FROM fitted) USING (symbol) GROUP BY symbol, n_train""", **RIDGE16))
def ridge_baseline(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.lagged_feature_table(df, axis).withColumns({c: F.round(c, 12) for c in (*features.FEATURES, "ret_1m")})
    return rounded(models.ridge_baseline(d, list(features.FEATURES), axis), 4)


@query(over("ticks", f"""
SELECT symbol, stored_rows, feature, ic, n_obs, violations, violations = 0 AS passed, oos_ic, oos_r2, n_train, n_test
FROM ({_IC}) JOIN (SELECT symbol, CAST(sum(violations) AS BIGINT) AS violations FROM ({_BROKEN}) GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol, count(*) AS stored_rows FROM lagged GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol, {r('corr(rx, ry)', 4)} AS oos_ic, {r('1 - sum(e * e) / (var_pop(y) * count(y))', 4)} AS oos_r2, count(*) AS n_test FROM ranks GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol, n_train FROM fitted) USING (symbol)""", **(LAGGED_STEPS | RIDGE16)))
def checked_full_run(spark, folder):
    """Features, targets and lags saved as Parquet; from the file the invariants, the rank IC of each feature and the ridge report."""
    df, axis = table(spark, folder, "ticks")
    # the rows come in runs of one symbol, which few tasks share: as they are, each folder is written by few tasks
    path = write_parquet(features.lagged_feature_table(df, axis), _scratch(spark, "full-run"), partition_by=("symbol",))
    lagged = read_parquet(spark, path)
    broken = validate.feature_invariants(lagged, axis).groupBy("symbol").agg(F.sum("violations").alias("violations"))
    stored = lagged.groupBy("symbol").agg(F.count("*").alias("stored_rows"))
    columns = [*features.FEATURES, "ret_1m"]
    d = lagged.select("symbol", "ts", "seq", *[F.round(c, 12).alias(c) for c in columns])
    # what both reports read is rounded and written once
    d = materialise(d.na.drop("any", subset=["symbol", *columns]))
    ic = rounded(stats.feature_ic(d, list(features.FEATURES), axis, stored=True), 4)
    ridge = rounded(models.ridge_baseline(d, list(features.FEATURES), axis, stored=True), 4)
    return ic.join(broken, "symbol").join(stored, "symbol").join(ridge, "symbol").withColumn("passed", F.col("violations") == 0)


RIDGE2 = {
    "t": f"""SELECT symbol, ts, seq, volume::DOUBLE AS a, bid_size::DOUBLE AS b, ln(lead(trade_price) OVER {W} / trade_price) AS y FROM ticks""",
    "k": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM t WHERE y IS NOT NULL""",
    "f": "SELECT symbol, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my FROM k WHERE is_train GROUP BY symbol",
    "z": "SELECT k.*, (a - ma) / sa AS u, (b - mb) / sb AS v, my FROM k JOIN f USING (symbol)",
    "g": """SELECT symbol, sum(u * u) + 1 AS uu, sum(v * v) + 1 AS vv, sum(u * v) AS uv, sum(u * (y - my)) AS uy, sum(v * (y - my)) AS vy
FROM z WHERE is_train GROUP BY symbol""",
    "c": "SELECT symbol, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS cu, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS cv FROM g",
    "s": "SELECT z.*, my + cu * u + cv * v AS yhat FROM z JOIN c USING (symbol) WHERE NOT is_train",
    "rk": f"SELECT *, {avg_rank('round(yhat, 13)', 'symbol')} AS rx, {avg_rank('y', 'symbol')} AS ry FROM s",
}


@query(over("ticks", f"""
SELECT symbol, {r('corr(rx, ry)', 4)} AS oos_ic, {r('1 - sum(pow(y - yhat, 2)) / (var_pop(y) * count(y))')} AS oos_r2, n_train, count(*) AS n_test
FROM rk JOIN (SELECT symbol, count(*) AS n_train FROM k WHERE is_train GROUP BY symbol) USING (symbol) GROUP BY symbol, n_train""", **RIDGE2))
def ridge_two_features(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.log_forward_returns(df, axis, "trade_price", {"next": 1})
    return rounded(models.ridge_baseline(d, ["volume", "bid_size"], axis, "target_next"), oos_ic=4)
