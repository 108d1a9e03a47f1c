"""Sources, sinks, filters, sorts and set operations."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import mid_price, zero_to_null
from ..operators import features, ofi, rows, stats, trades
from ..plans import with_positions
from ..plans.layout import shared_folder
from ..sources import downcast_floats, read_csv, verify_stored, with_session_date, write_csv, write_parquet
from .base import W, WD, over, query, r, rounded, table


def _scratch(spark, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tickloom-{kind}-{uuid.uuid4().hex}"


RET = f"SELECT *, close / lag(close) OVER {WD} - 1 AS ret FROM daily"


def daily_returns(spark, folder):
    df, axis = table(spark, folder, "daily")
    return trades.with_returns(df, axis, price="close"), axis


@query(over("daily", "SELECT symbol, date, close, volume FROM daily"))
def csv_round_trip(spark, folder):
    df, _ = table(spark, folder, "daily")
    path = write_csv(df, _scratch(spark, "csv"))
    return read_csv(spark, path, "symbol STRING, date TIMESTAMP_NTZ, close DOUBLE, volume BIGINT")


@query(over("daily", "SELECT symbol, date, close FROM daily WHERE date >= DATE '1996-01-01' AND date < DATE '1999-01-01'"))
def bars_in_date_range(spark, folder):
    df, _ = table(spark, folder, "daily")
    path = write_parquet(df, _scratch(spark, "bars"))
    bars = spark.read.schema("symbol STRING, date TIMESTAMP_NTZ, close DOUBLE").parquet(path)
    return rows.between_dates(bars, "date", date(1996, 1, 1), date(1998, 12, 31))


@query(over("ticks", """
SELECT count(*) AS rows, 12 AS columns, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(0 AS BIGINT) AS missing, count(*) AS expected_rows, true AS passed FROM ticks"""))
def parquet_round_trip(spark, folder):
    df, axis = table(spark, folder, "ticks")
    stored = with_session_date(df).withColumns({"mid_price": mid_price(), "weekday": F.dayofweek("ts").cast("double")})
    path = write_parquet(
        stored, _scratch(spark, "features"), partition_by=("symbol", "session_date"), float32=True,
        spread_by=("symbol", "session_date", "ts"),
    )
    return verify_stored(spark, path, axis, downcast_floats(stored), ("symbol", "session_date")).drop("schema")


@query(over("ticks", "SELECT symbol, seq, CAST(CAST((bid_price * 7 + ask_price) / 3 AS FLOAT) AS DOUBLE) AS x FROM ticks"))
def float32_downcast(spark, folder):
    df, _ = table(spark, folder, "ticks")
    wide = df.select("symbol", "seq", ((F.col("bid_price") * 7 + F.col("ask_price")) / 3).alias("x"))
    return downcast_floats(wide).withColumn("x", F.col("x").cast("double"))


@query(over("daily", """
SELECT date, max(CASE WHEN symbol = '1-URGENT' THEN close END) AS "left",
       max(CASE WHEN symbol = '2-HIGH' THEN close END) AS "right"
FROM daily WHERE symbol IN ('1-URGENT', '2-HIGH') GROUP BY date"""))
def paired_closes(spark, folder):
    df, _ = table(spark, folder, "daily")
    return stats.pair_table(df, "1-URGENT", "2-HIGH")


@query(over("ticks", "SELECT symbol, ts, bid_price, ask_price FROM ticks"))
def column_subset(spark, folder):
    return table(spark, folder, "ticks")[0].select("symbol", "ts", "bid_price", "ask_price")


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret FROM x WHERE ret < -0.02", x=RET))
def crash_days(spark, folder):
    df, _ = daily_returns(spark, folder)
    return rounded(rows.beyond(df, "ret", -0.02).select("symbol", "date", "ret"))


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret FROM x WHERE ret > 0.02", x=RET))
def rally_days(spark, folder):
    df, _ = daily_returns(spark, folder)
    return rounded(rows.beyond(df, "ret", 0.02).select("symbol", "date", "ret"))


@query(over("daily", """
SELECT symbol, count(*) FILTER (ret < -0.02) AS crashes, count(*) FILTER (ret > 0.02) AS rallies, count(*) AS rows
FROM x GROUP BY symbol""", x=RET))
def crash_and_rally_counts(spark, folder):
    df, axis = daily_returns(spark, folder)
    return rows.move_counts(df, axis)


@query(over("daily", """
SELECT symbol, date, CASE WHEN ret < -0.02 THEN 'crash' WHEN ret > 0.02 THEN 'rally' ELSE 'normal' END AS bucket FROM x""", x=RET))
def move_buckets(spark, folder):
    df, _ = daily_returns(spark, folder)
    return df.select("symbol", "date", rows.move_bucket().alias("bucket"))


@query(over("ticks", "SELECT symbol, ts, seq FROM ticks WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21'"))
def date_slice(spark, folder):
    df, _ = table(spark, folder, "ticks")
    return rows.between_dates(df, "ts", date(2024, 1, 3), date(2024, 1, 20)).select("symbol", "ts", "seq")


@query(over("ticks", "SELECT symbol, ts, seq FROM ticks WHERE CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'"))
def session_hours(spark, folder):
    df, _ = table(spark, folder, "ticks")
    return rows.session_hours(df).select("symbol", "ts", "seq")


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM dirty WHERE price IS NOT NULL"))
def complete_rows(spark, folder):
    return rows.drop_incomplete(table(spark, folder, "dirty")[0])


GAPPY = """SELECT symbol, ts, seq, CASE WHEN price > 0 THEN price END AS price,
CASE WHEN volume > 0 THEN volume END AS volume, CASE WHEN volume > 0 AND price > 0 THEN price * volume END AS value FROM dirty"""


def gappy(spark, folder):
    df, _ = table(spark, folder, "dirty")
    p, v = F.when(F.col("price") > 0, F.col("price")), F.when(F.col("volume") > 0, F.col("volume"))
    return df.withColumns({"price": p, "volume": v}).withColumn("value", F.col("price") * F.col("volume"))


@query(over("dirty", "SELECT * FROM x WHERE price IS NOT NULL AND value IS NOT NULL", x=GAPPY))
def complete_in_subset(spark, folder):
    return rows.drop_incomplete(gappy(spark, folder), subset=["price", "value"])


@query(over("dirty", "SELECT * FROM x WHERE NOT (price IS NULL AND volume IS NULL AND value IS NULL)", x=GAPPY))
def not_all_missing(spark, folder):
    return rows.drop_incomplete(gappy(spark, folder), "all", subset=["price", "volume", "value"])


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret FROM x WHERE ret IS NOT NULL", x=RET))
def known_returns(spark, folder):
    df, _ = daily_returns(spark, folder)
    return rounded(df.filter(F.col("ret").isNotNull()).select("symbol", "date", "ret"))


@query(over("dirty", "SELECT symbol, ts, seq, price FROM dirty WHERE price > 0"))
def positive_prices(spark, folder):
    return rows.positive_only(table(spark, folder, "dirty")[0]).select("symbol", "ts", "seq", "price")


@query(over("dirty", """
SELECT symbol, seq, volume FROM dirty JOIN c USING (symbol) WHERE volume > 0 AND volume < cap""",
    c="SELECT symbol, avg(volume) + 5 * stddev_samp(volume) AS cap FROM dirty GROUP BY symbol"))
def sane_volumes(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return rows.volume_within(df, axis).select("symbol", "seq", "volume")


@query(over("dirty", "SELECT symbol, seq, CASE WHEN volume <> 0 THEN volume END AS known, coalesce(price, 0) AS filled FROM dirty"))
def zero_guard_and_fill(spark, folder):
    df, _ = table(spark, folder, "dirty")
    return df.select("symbol", "seq", zero_to_null("volume").alias("known"), F.coalesce("price", F.lit(0.0)).alias("filled"))


SIZE_OFI = f"""SELECT *, bid_size - lag(bid_size) OVER {W} - (ask_size - lag(ask_size) OVER {W}) AS ofi FROM ticks"""


@query(over("ticks", f"""
SELECT symbol, seq, {r('CASE WHEN ofi IS NOT NULL THEN least(greatest(ofi, lo), hi) END')} AS clipped FROM x JOIN q USING (symbol)""",
    x=SIZE_OFI, q="SELECT symbol, quantile_cont(ofi, 0.01) AS lo, quantile_cont(ofi, 0.99) AS hi FROM x GROUP BY symbol"))
def winsorised_ofi(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_ofi(df, axis, "size_only")
    return rounded(rows.winsorise(d, axis, out="clipped").select("symbol", "seq", F.col("clipped").cast("double")))


@query(over("ticks", f"SELECT symbol, {r('100 * avg(CASE WHEN ofi > 0 THEN 1.0 WHEN ofi <= 0 THEN 0.0 END)')} AS share FROM x GROUP BY symbol", x=SIZE_OFI))
def share_of_buying(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(ofi.with_ofi(df, axis, "size_only").groupBy("symbol").agg(rows.share_positive("ofi").alias("share")))


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret FROM x ORDER BY ret ASC NULLS LAST LIMIT 5", x=RET))
def worst_days(spark, folder):
    df, _ = daily_returns(spark, folder)
    return rounded(rows.extremes(df, "ret").select("symbol", "date", "ret"))


@query(over("daily", f"SELECT symbol, date, {r('ret')} AS ret FROM x ORDER BY ret DESC NULLS LAST LIMIT 5", x=RET))
def best_days(spark, folder):
    df, _ = daily_returns(spark, folder)
    return rounded(rows.extremes(df, "ret", worst=False).select("symbol", "date", "ret"))


@query(over("ticks", "SELECT symbol, ts, seq FROM ticks ORDER BY ts, seq LIMIT 5"))
def first_ticks(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rows.first_rows(df, axis).select("symbol", "ts", "seq")


@query(over("ticks", "SELECT symbol, ts, seq FROM ticks ORDER BY ts DESC, seq DESC LIMIT 5"))
def last_ticks(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rows.first_rows(df, axis, last=True).select("symbol", "ts", "seq")


@query(over("ticks", """
SELECT symbol, arg_min(seq, ts) AS first_seq, arg_max(seq, ts) AS last_seq,
       arg_min(trade_price, ts) AS first_trade_price, arg_max(trade_price, ts) AS last_trade_price FROM ticks GROUP BY symbol"""))
def first_and_last_ticks(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rows.ends(df, axis, ["seq", "trade_price"])


@query(over("quotes trades", "SELECT symbol, ts, seq FROM quotes UNION ALL SELECT symbol, ts, seq FROM trades"))
def appended_rows(spark, folder):
    q, t = table(spark, folder, "quotes")[0], table(spark, folder, "trades")[0]
    return rows.append(q.select("symbol", "ts", "seq"), t.select("ts", "seq", "symbol"))


@query(over("ticks", "SELECT * FROM ticks ORDER BY md5(concat_ws('|', '42', symbol, CAST(seq AS VARCHAR))), symbol, seq LIMIT 100"))
def fixed_sample(spark, folder):
    return rows.pick(table(spark, folder, "ticks")[0], 100, ["symbol", "seq"])


@query(over("ticks", f"SELECT symbol, ts, seq, ofi, {r('ret')} AS ret FROM x JOIN y USING (symbol, ts, seq) WHERE ofi IS NOT NULL AND ret IS NOT NULL",
    x=SIZE_OFI.replace("SELECT *", "SELECT symbol, ts, seq"),
    y=f"SELECT symbol, ts, seq, lead(trade_price) OVER {W} / trade_price - 1 AS ret FROM ticks"))
def aligned_signal_and_return(spark, folder):
    df, axis = table(spark, folder, "ticks")
    on = ["symbol", "ts", "seq"]
    signal = ofi.with_ofi(df, axis, "size_only").select(*on, "ofi")
    target = features.forward_return(df, axis, price="trade_price", out="ret").select(*on, "ret")
    return rounded(rows.align(signal, target, on))


@query(over("ticks", f"SELECT symbol, seq, row_number() OVER {W} - 1 AS row_index FROM ticks"))
def row_positions(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return with_positions(df, axis).select("symbol", "seq", F.col("_pos").alias("row_index"))
