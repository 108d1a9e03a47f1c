"""Feature table, targets, lag tables, split, backtest, normalisation, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quoted_spread, weighted_mid
from ..operators import features, normalize, ofi, stats, validate
from ..plans import Axis
from .base import W, WD, frame, full, over, query, r, rounded, table
from .books_and_flow import LAMBDA, MICRO, MID, SIGNED
from .cleaning_and_bars import SIDED
from .selection import RET, SIZE_OFI

# The sixteen features in SQL, step by step as the operator defines them.
BASE = f"""SELECT *, ask_price - bid_price AS spread, {MICRO} AS microprice,
CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0.0 END AS queue_imbalance,
sign(trade_price - {MID}) AS sgn, sign(trade_price - {MID}) * volume AS sv, trade_price / lag(trade_price) OVER {W} - 1 AS ret,
sum(trade_price * volume) OVER {W} / sum(volume) OVER {W} AS vwap FROM s"""
FEATS = f"""SELECT *, {', '.join(f"CAST({full('sum', 'ofi', n)} AS BIGINT) AS {k}" for k, n in ofi.OFI_SUMS.items())},
spread - lag(spread) OVER {W} AS spread_change, {full('avg', 'sgn', 6)} AS trade_imbalance, {LAMBDA} AS kyle_lambda,
abs(ret) / nullif(volume, 0) AS amihud, {full('stddev_samp', 'ret', 20)} AS realized_vol,
ofi / nullif({full('stddev_samp', 'ofi', 20)}, 0) AS ofi_norm FROM base"""
LAGGED = f"""SELECT symbol, ts, seq, trade_price, {', '.join(f'lag({c}) OVER {W} AS {c}' for c in features.FEATURES)},
{', '.join(f'ln(lead(trade_price, {k}) OVER {W} / trade_price) AS {t}' for t, k in features.TARGETS.items())} FROM feats"""
FEATURE_STEPS = {"sided": SIDED, "s": SIGNED, "base": BASE, "feats": FEATS}
LAGGED_STEPS = FEATURE_STEPS | {"lagged": LAGGED}
WHOLE_STEPS = LAGGED_STEPS | {
    "whole": "SELECT * FROM lagged WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in (*features.FEATURES, "ret_1m"))
}
DIGITS = {"kyle_lambda": 10, "amihud": 10, "realized_vol": 8, "ret_10s": 8, "ret_1m": 8, "ret_5m": 8}
INTEGERS = ("ofi", *ofi.OFI_SUMS)


def listed(columns) -> str:
    return ", ".join(c if c in INTEGERS else f"{r(c, DIGITS.get(c, 6))} AS {c}" for c in columns)


@query(over("ticks", f"SELECT symbol, seq, {listed(features.FEATURES)} FROM feats", **FEATURE_STEPS))
def feature_table(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(features.compute_features(df, axis).select("symbol", "seq", *features.FEATURES), **DIGITS)


@query(over("ticks", f"SELECT symbol, seq, {listed((*features.FEATURES, *features.TARGETS))} FROM lagged", **LAGGED_STEPS))
def lagged_features_and_targets(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.lagged_feature_table(df, axis).select("symbol", "seq", *features.FEATURES, *features.TARGETS)
    return rounded(d, **DIGITS)


@query(over("ticks", f"SELECT symbol, seq, {listed((*features.FEATURES, *features.TARGETS))} FROM lagged", **LAGGED_STEPS))
def split_key_features(spark, folder):
    df, axis = table(spark, folder, "ticks", Axis(rows_per_task=400))
    d = features.lagged_feature_table(df, axis).select("symbol", "seq", *features.FEATURES, *features.TARGETS)
    return rounded(d, **DIGITS)


@query(over("ticks", f"""
SELECT symbol, seq, {', '.join(f"{r(f'ln(lead(trade_price, {k}) OVER {W} / trade_price)', 8)} AS target_{h}" for h, k in (('10s', 1), ('1m', 6), ('5m', 30)))}
FROM ticks"""))
def log_targets(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.log_forward_returns(df, axis, "trade_price")
    return rounded(d.select("symbol", "seq", "target_10s", "target_1m", "target_5m"), 8)


@query(over("ticks", f"""
SELECT symbol, seq, {r(f'lead(m, 3) OVER {W} / lead(m, 2) OVER {W} - 1', 8)} AS one_step, {r(f'lead(m, 3) OVER {W} / m - 1', 8)} AS whole_span
FROM (SELECT *, {MICRO} AS m FROM ticks)"""))
def microprice_forward_returns(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = df.withColumn("weighted_mid", weighted_mid())
    d = features.forward_return(d, axis, horizon=3, out="one_step")
    d = features.forward_return(d, axis, horizon=3, whole_span=True, out="whole_span")
    return rounded(d.select("symbol", "seq", "one_step", "whole_span"), 8)


LAG_BASE = ("ofi", "queue_imbalance", "ofi_norm", "volume_norm")
LAG_COLUMNS = [f"{c}_lag{k}" for c in LAG_BASE for k in (1, 2, 3)]
LAG_STEPS = {
    "x": SIZE_OFI,
    "y": f"""SELECT *, (bid_size - ask_size) / (bid_size + ask_size) AS queue_imbalance, ofi / nullif({full('stddev_samp', 'ofi', 20, 1)}, 0) AS ofi_norm,
volume / nullif({full('avg', 'volume', 20, 1)}, 0) AS volume_norm, ln(lead(trade_price, 6) OVER {W} / trade_price) AS target_1m FROM x""",
    "z": f"SELECT symbol, seq, target_1m, {', '.join(f'lag({c}, {k}) OVER {W} AS {c}_lag{k}' for c in LAG_BASE for k in (1, 2, 3))} FROM y",
}


@query(over("ticks", f"""
SELECT symbol, seq, {r('target_1m', 8)} AS target_1m, {', '.join(c if c.startswith('ofi_lag') else f'{r(c)} AS {c}' for c in LAG_COLUMNS)} FROM z
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in LAG_COLUMNS)} AND target_1m IS NOT NULL""", **LAG_STEPS))
def lag_model_table(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.lag_model_table(df, axis, price="trade_price")
    return rounded(d.select("symbol", "seq", "target_1m", *LAG_COLUMNS), target_1m=8)


@query(over("ticks", """
SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM ticks"""))
def chronological_split(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return features.chronological_split(df, axis).select("symbol", "seq", "is_train")


BACKTEST = {
    "x": RET,
    "y": f"""SELECT symbol, date, close, volume, ret AS returns, {full('avg', 'ret', 20, order='date')} AS rolling_mean, lag(ret) OVER {WD} AS lag_returns, lead(ret) OVER {WD} AS target FROM x""",
    "z": """SELECT *, lag_returns > rolling_mean AS signal, CAST(lag_returns > rolling_mean AS INTEGER) AS position,
CAST(lag_returns > rolling_mean AS INTEGER) * target AS strategy FROM y WHERE returns IS NOT NULL AND rolling_mean IS NOT NULL AND lag_returns IS NOT NULL AND target IS NOT NULL""",
}


@query(over("daily", f"""
SELECT symbol, date, signal, position, {r('strategy')} AS strategy, {r(f'ln(product(1 + strategy) OVER {WD})')} AS log_equity FROM z""", **BACKTEST))
def moving_average_backtest(spark, folder):
    df, axis = table(spark, folder, "daily")
    d = features.backtest(df, axis)
    return rounded(d.select("symbol", "date", "signal", "position", "strategy", F.ln("equity").alias("log_equity")))


NORM = {"x": SIZE_OFI, "st": "SELECT symbol, avg(ofi) AS m, stddev_samp(ofi) AS s, min(ofi) AS lo, max(ofi) AS hi, count(ofi) AS n FROM x GROUP BY symbol"}


def _norm_input(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return ofi.with_ofi(df, axis, "size_only").select("symbol", "ts", "seq", "ofi", "volume"), axis


@query(over("ticks", f"""
SELECT symbol, seq, {r('(ofi - m) / s')} AS ofi_z, {r('(ofi - lo) / (hi - lo)')} AS ofi_mm,
       CASE WHEN ofi IS NOT NULL THEN {r("(rank() OVER (PARTITION BY symbol ORDER BY ofi NULLS LAST) + (count(*) OVER (PARTITION BY symbol, ofi) - 1) / 2.0) / n")} END AS ofi_rank
FROM x JOIN st USING (symbol)""", **NORM))
def normalised_full_sample(spark, folder):
    d, axis = _norm_input(spark, folder)
    for method, suffix in (("zscore", "_z"), ("minmax", "_mm"), ("rank", "_rank")):
        d = normalize.normalize_features(d, ["ofi"], axis, method, suffix=suffix)
    return rounded(d.select("symbol", "seq", "ofi_z", "ofi_mm", "ofi_rank"))


@query(over("ticks", f"""
SELECT symbol, seq, {r(f'(volume - avg(volume) OVER {frame(50)}) / nullif(stddev_samp(volume) OVER {frame(50)}, 0)')} AS volume_z,
       {r(f'(volume - min(volume) OVER {frame(50)}) / nullif(max(volume) OVER {frame(50)} - min(volume) OVER {frame(50)}, 0)')} AS volume_mm FROM ticks"""))
def normalised_rolling(spark, folder):
    d, axis = _norm_input(spark, folder)
    for method, suffix in (("zscore", "_z"), ("minmax", "_mm")):
        d = normalize.normalize_features(d, ["volume"], axis, method, 50, suffix=suffix)
    return rounded(d.select("symbol", "seq", "volume_z", "volume_mm"))


@query(over("ticks", f"""
SELECT symbol, seq, {r('(volume - m) / coalesce(nullif(s, 0), 1)')} AS volume_scaled, is_train FROM t
JOIN (SELECT symbol, avg(volume) AS m, stddev_pop(volume) AS s FROM t WHERE is_train GROUP BY symbol) USING (symbol)""",
    t="""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) <= floor(0.7 * count(*) OVER (PARTITION BY symbol)) AS is_train FROM ticks"""))
def scaled_on_train(spark, folder):
    df, axis = table(spark, folder, "ticks")
    split = features.chronological_split(df, axis)
    d = normalize.standardise_on_train(split, ["volume"], axis, suffix="_scaled")
    return rounded(d.select("symbol", "seq", "volume_scaled", "is_train"))


@query(over("ticks", f"""
SELECT symbol, 'ofi' AS feature, stage, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max,
       {r('skewness(v)', 4)} AS skew, {r('kurtosis(v)', 4)} AS kurt, count(*) FILTER (v IS NULL) AS missing
FROM (SELECT symbol, 'before' AS stage, CAST(ofi AS DOUBLE) AS v FROM x UNION ALL SELECT symbol, 'after', (ofi - m) / s FROM x JOIN st USING (symbol))
GROUP BY symbol, stage""", **NORM))
def normalisation_audit(spark, folder):
    d, axis = _norm_input(spark, folder)
    d = normalize.normalize_features(d, ["ofi"], axis, "zscore", suffix="_z")
    return rounded(normalize.normalization_audit(d, {"ofi": ("ofi", "ofi_z")}, axis), skew=4, kurt=4)


RAW = ("ofi", "spread", "volume", "microprice")
AUDIT_STEPS = {
    "x": SIZE_OFI,
    "raw": f"SELECT symbol, ts, seq, CAST(coalesce(ofi, 0) AS BIGINT) AS ofi, ask_price - bid_price AS spread, volume, {MICRO} AS microprice FROM x",
    "m": f"""SELECT * FROM (SELECT symbol, ts, seq, {', '.join(f'lag({c}) OVER {W} AS {c}' for c in RAW)},
ln(lead(microprice) OVER {W} / microprice) AS target_1m FROM raw) WHERE ofi IS NOT NULL AND target_1m IS NOT NULL""",
}


def _audit_tables(spark, folder):
    df, axis = table(spark, folder, "ticks")
    raw = ofi.with_ofi(df, axis, "size_only").select(
        "symbol", "ts", "seq", F.coalesce("ofi", F.lit(0)).cast("bigint").alias("ofi"), quoted_spread().alias("spread"),
        "volume", weighted_mid().alias("microprice"),
    )
    target = features.log_forward_returns(raw, axis, "microprice", {"1m": 1})
    lagged = features.lag_in_place(target, list(RAW), axis)
    return raw, lagged, lagged.na.drop("any"), axis


@query(over("ticks", f"SELECT symbol, ts, seq, ofi, spread, volume, {r('microprice')} AS microprice, {r('target_1m', 8)} AS target_1m FROM m", **AUDIT_STEPS))
def leak_free_table(spark, folder):
    return rounded(_audit_tables(spark, folder)[2], target_1m=8)


@query(over("ticks", " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS feature, {r(f'CAST(arg_min({c}, ts) AS DOUBLE)')} AS first_value, true AS passed FROM m GROUP BY symbol" for c in RAW), **AUDIT_STEPS))
def lookahead_audit(spark, folder):
    _, _, model, axis = _audit_tables(spark, folder)
    return rounded(validate.first_row_audit(model, list(RAW), axis))


@query(over("ticks", " UNION ALL ".join(
    f"SELECT symbol, count(*) AS rows, '{c}' AS feature, CAST(0 AS BIGINT) AS mismatches, true AS passed FROM m GROUP BY symbol" for c in RAW), **AUDIT_STEPS))
def lag_validation(spark, folder):
    raw, _, model, axis = _audit_tables(spark, folder)
    return validate.lag_mismatches(raw, model, list(RAW), axis)


@query(over("ticks", f"""
SELECT symbol, min(CASE WHEN ofi IS NOT NULL THEN ts END) AS first_valid, max(CASE WHEN ofi IS NOT NULL THEN ts END) AS last_valid, count(*) AS rows,
       count(*) FILTER (ofi IS NULL) AS rows_dropped FROM (SELECT *, lag(volume) OVER {W} AS ofi FROM ticks) GROUP BY symbol"""))
def usable_span(spark, folder):
    _, lagged, _, axis = _audit_tables(spark, folder)
    return validate.usable_span(lagged, list(RAW), axis)


INVARIANTS = {
    "spread_positive": "count(*) FILTER (NOT spread > 0)",
    "queue_imbalance_in_range": "count(*) FILTER (queue_imbalance NOT BETWEEN -1 AND 1)",
    "trade_imbalance_in_range": "count(*) FILTER (trade_imbalance NOT BETWEEN -1 AND 1)",
    "realized_vol_not_negative": "count(*) FILTER (realized_vol < 0)",
    "first_row_missing": "CAST(0 AS BIGINT)",
    "target_not_a_feature": "CAST(0 AS BIGINT)",
}


@query(over("ticks", " UNION ALL ".join(
    f'SELECT symbol, \'{k}\' AS "check", {v} AS violations, {v} = 0 AS passed FROM lagged GROUP BY symbol' for k, v in INVARIANTS.items()), **LAGGED_STEPS))
def feature_invariants(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return validate.feature_invariants(features.lagged_feature_table(df, axis), axis)


@query(over("ticks", f"""
SELECT symbol, 'volume' AS "column", {r('min(v)')} AS min, {r('max(v)')} AS max, true AS passed
FROM (SELECT symbol, (rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS v FROM ticks)
GROUP BY symbol"""))
def normalised_range_check(spark, folder):
    d, axis = _norm_input(spark, folder)
    return rounded(validate.range_check(normalize.normalize_features(d, ["volume"], axis), ["volume"], axis))


@query(over("ticks", f"""
SELECT gap_us, count(*) AS n FROM (SELECT date_diff('microsecond', lag(ts) OVER {W}, ts) AS gap_us FROM ticks) WHERE gap_us IS NOT NULL
GROUP BY gap_us ORDER BY n DESC, gap_us LIMIT 5"""))
def row_spacing(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return stats.spacing_counts(df, axis)
