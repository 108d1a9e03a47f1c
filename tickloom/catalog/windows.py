"""Lags, differences, rolling and cumulative values, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, normalize, ofi, trades
from ..plans import Axis, Rolling, after, average_rank, change, over_rows, running, with_rolling
from .base import W, WD, frame, full, over, query, r, rounded, table
from .selection import RET, SIZE_OFI, daily_returns


@query(over("ticks", f"""
SELECT symbol, seq, lag(bid_size, 1) OVER w AS bid_size_lag1, lag(bid_size, 2) OVER w AS bid_size_lag2, lag(bid_size, 3) OVER w AS bid_size_lag3,
       lag(volume, 1) OVER w AS volume_lag1, lag(volume, 2) OVER w AS volume_lag2, lag(volume, 3) OVER w AS volume_lag3
FROM ticks WINDOW w AS {W}"""))
def lagged_columns(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = features.lag_features(df, ["bid_size", "volume"], axis)
    return d.select("symbol", "seq", *[f"{c}_lag{k}" for c in ("bid_size", "volume") for k in (1, 2, 3)])


@query(over("ticks", f"""
SELECT symbol, seq, lead(trade_price, 6) OVER {W} AS ahead, ask_price - bid_price - lag(ask_price - bid_price) OVER {W} AS moved FROM ticks"""))
def lead_and_difference(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        return d.withColumns({"ahead": after("trade_price", w, 6), "moved": change(F.col("ask_price") - F.col("bid_price"), w)})

    return over_rows(df, axis, build, back=1, ahead=6).select("symbol", "seq", "ahead", "moved")


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret, {r(f'ln(close / lag(close) OVER {WD})')} AS log_ret FROM x", x=RET))
def daily_return_kinds(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(trades.with_returns(df, axis, "close", "log_ret", log=True).select("symbol", "date", "ret", "log_ret"))


@query(over("dirty", f"""
SELECT symbol, seq, {r(f'px / nullif(lag(px) OVER {W}, 0) - 1')} AS ret FROM x""",
    x=f"SELECT symbol, ts, seq, last_value(price IGNORE NULLS) OVER {W} AS px FROM dirty"))
def returns_over_gaps(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return rounded(trades.with_returns(df, axis, ffill=True).select("symbol", "seq", "ret"))


@query(over("daily", f"""
SELECT symbol, date, {r(full('avg', 'ret', 20, order='date'))} AS rolling_mean, {r(full('stddev_samp', 'ret', 20, order='date'))} AS rolling_std FROM x""", x=RET))
def rolling_mean_and_std(spark, folder):
    df, axis = daily_returns(spark, folder)

    def build(d, w):
        return with_rolling(d, w, rolling_mean=Rolling("mean", "ret", 20), rolling_std=Rolling("std", "ret", 20))

    return rounded(over_rows(df, axis, build, back=19).select("symbol", "date", "rolling_mean", "rolling_std"))


@query(over("ticks", "SELECT symbol, seq, " + ", ".join(
    f"{r(full('avg', 'ofi', n))} AS ofi_mean_{n}, {r(full('stddev_samp', 'ofi', n))} AS ofi_std_{n}, CAST({full('sum', 'ofi', n)} AS BIGINT) AS ofi_sum_{n}"
    for n in (5, 10)) + " FROM x", x=SIZE_OFI))
def rolling_ofi(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_rolling_ofi(ofi.with_ofi(df, axis, "size_only"), axis)
    return rounded(d.select("symbol", "seq", *[f"ofi_{s}_{n}" for n in (5, 10) for s in ("mean", "std", "sum")]))


@query(over("ticks", "SELECT symbol, seq, " + ", ".join(
    f"CAST({full('sum', 'ofi', n)} AS BIGINT) AS {label}" for label, n in ofi.OFI_SUMS.items()) + " FROM x", x=SIZE_OFI))
def ofi_row_sums(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_ofi_sums(ofi.with_ofi(df, axis, "size_only"), axis)
    return d.select("symbol", "seq", *ofi.OFI_SUMS)


@query(over("ticks", f"SELECT symbol, seq, min(trade_price) OVER {frame(30)} AS low, max(trade_price) OVER {frame(30)} AS high FROM ticks"))
def rolling_low_and_high(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        return with_rolling(d, w, low=Rolling("min", "trade_price", 30, need=1), high=Rolling("max", "trade_price", 30, need=1))

    return over_rows(df, axis, build, back=29).select("symbol", "seq", "low", "high")


@query(over("ticks", f"""
SELECT symbol, seq, {r(full('avg', 'volume', 20, 1))} AS prior_mean, {r(full('stddev_samp', 'volume', 20, 1))} AS prior_std FROM ticks"""))
def rolling_before_current_row(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        return with_rolling(d, w, prior_mean=Rolling("mean", "volume", 20, skip=1), prior_std=Rolling("std", "volume", 20, skip=1))

    return rounded(over_rows(df, axis, build, back=20).select("symbol", "seq", "prior_mean", "prior_std"))


@query(over("ticks", f"SELECT symbol, seq, CAST(sum(volume) OVER {W} AS BIGINT) AS traded, max(trade_price) OVER {W} AS top FROM ticks"))
def running_sum_and_top(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return running(df, axis, traded=("sum", "volume"), top=("max", "trade_price")).select("symbol", "seq", "traded", "top")


@query(over("daily", f"SELECT symbol, date, {r(f'product(1 + ret / 1000) OVER {WD}')} AS growth FROM x", x=RET))
def running_product(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rounded(running(df, axis, growth=("product", 1 + F.col("ret") / 1000)).select("symbol", "date", "growth"))


RANK = """(rank() OVER (PARTITION BY symbol ORDER BY trade_price) + (count(*) OVER (PARTITION BY symbol, trade_price) - 1) / 2.0)"""


@query(over("ticks", f"SELECT symbol, seq, {r(RANK)} AS price_rank FROM ticks"))
def average_ranks(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(average_rank(df, axis, price_rank="trade_price").select("symbol", "seq", "price_rank"))


def rolling_rank_sql(n: int) -> str:
    return f"""SELECT a.symbol, a.seq, {r('''(count(*) FILTER (b.volume < a.volume) + (count(*) FILTER (b.volume = a.volume) + 1) / 2.0) / count(*)''')} AS volume_rank
FROM p a JOIN p b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {n - 1} AND a.i GROUP BY a.symbol, a.seq"""


NUMBERED = f"SELECT symbol, seq, volume, row_number() OVER {W} AS i FROM ticks"


@query(over("ticks", rolling_rank_sql(50), p=NUMBERED))
def rolling_ranks(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = normalize.normalize_features(df.select("symbol", "ts", "seq", "volume"), ["volume"], axis, "rank", 50, suffix="_rank")
    return rounded(d.select("symbol", "seq", "volume_rank"))


def _small_tasks(spark, folder, rows: int = 500):
    """The tick table on an axis whose keys are all too large for one task."""
    return table(spark, folder, "ticks", Axis(rows_per_task=rows))


@query(over("ticks", f"""
SELECT symbol, seq, CAST({full('sum', 'ofi', 60)} AS BIGINT) AS ofi_10m, {r(full('stddev_samp', 'ofi', 20))} AS ofi_std, lead(trade_price, 30) OVER {W} AS ahead
FROM x""", x=SIZE_OFI))
def split_key_rolling(spark, folder):
    df, axis = _small_tasks(spark, folder)

    def build(d, w):
        d = d.withColumn("ofi", ofi.ofi_column(w, "size_only"))
        d = with_rolling(d, w, ofi_10m=Rolling("sum", "ofi", 60), ofi_std=Rolling("std", "ofi", 20))
        return d.withColumn("ahead", after("trade_price", w, 30))

    return rounded(over_rows(df, axis, build, back=60, ahead=30).select("symbol", "seq", "ofi_10m", "ofi_std", "ahead"))


@query(over("ticks", f"SELECT symbol, seq, CAST(sum(volume) OVER {W} AS BIGINT) AS traded, min(trade_price) OVER {W} AS low FROM ticks"))
def split_key_running(spark, folder):
    df, axis = _small_tasks(spark, folder)
    return running(df, axis, traded=("sum", "volume"), low=("min", "trade_price")).select("symbol", "seq", "traded", "low")


@query(over("ticks", f"SELECT symbol, seq, {r(RANK)} AS price_rank FROM ticks"))
def split_key_ranks(spark, folder):
    df, axis = _small_tasks(spark, folder)
    return rounded(average_rank(df, axis, price_rank="trade_price").select("symbol", "seq", "price_rank"))


COV20 = "(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(over("ticks", f"""
SELECT symbol, seq, CASE WHEN count(bid_size * ofi) OVER {COV20} >= 20 THEN {r(f'covar_samp(bid_size, ofi) OVER {COV20}', 3)} END AS cov,
       CASE WHEN count(ofi) OVER {COV20} >= 20 THEN {r(f'var_samp(ofi) OVER {COV20}', 3)} END AS var FROM x""", x=SIZE_OFI))
def rolling_covariance(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        d = d.withColumn("ofi", ofi.ofi_column(w, "size_only"))
        return with_rolling(d, w, cov=Rolling("cov", "bid_size", 20, y="ofi"), var=Rolling("var", "ofi", 20))

    return rounded(over_rows(df, axis, build, back=20).select("symbol", "seq", "cov", "var"), 3)


@query(over("ticks", f"""
SELECT symbol, seq, {r(full('avg', 'trade_price', 2000))} AS mean, {r(full('stddev_samp', 'trade_price', 2000))} AS std, min(volume) OVER {frame(2000)} AS low,
       max(volume) OVER {frame(2000)} AS high, {r(f'covar_samp(bid_size, ask_size) OVER {frame(2000)}', 3)} AS cov
FROM ticks"""))
def rolling_values_of_long_frames(spark, folder):
    """Frames of 2,000 rows, on keys that are cut into runs shorter than a frame."""
    df, axis = _small_tasks(spark, folder)

    def build(d, w):
        return with_rolling(
            d, w, mean=Rolling("mean", "trade_price", 2000), std=Rolling("std", "trade_price", 2000), low=Rolling("min", "volume", 2000, need=1),
            high=Rolling("max", "volume", 2000, need=1), cov=Rolling("cov", "bid_size", 2000, y="ask_size", need=2),
        )

    return rounded(over_rows(df, axis, build, back=1999).select("symbol", "seq", "mean", "std", "low", "high", "cov"), cov=3)


@query(over("ticks", rolling_rank_sql(400), p=NUMBERED))
def split_key_rolling_ranks(spark, folder):
    df, axis = _small_tasks(spark, folder)
    d = normalize.normalize_features(df.select("symbol", "ts", "seq", "volume"), ["volume"], axis, "rank", 400, suffix="_rank")
    return rounded(d.select("symbol", "seq", "volume_rank"))
