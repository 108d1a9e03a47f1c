"""Quote features, order-book events, order-flow imbalance, trades against quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    effective_spread, mid_price, queue_imbalance, queue_imbalance_levels, quoted_spread, trade_side, weighted_mid,
)
from ..operators import ofi, orderbook, trades
from ..plans import lay_out, over_rows
from .base import W, full, over, query, r, rounded, table
from .cleaning_and_bars import CONT, SIDED
from .selection import SIZE_OFI

MID = "((bid_price + ask_price) / 2)"
MICRO = "((bid_size * ask_price + ask_size * bid_price) / (bid_size + ask_size))"


@query(over("ticks", f"""
SELECT symbol, seq, {MID} AS mid_price, {r(MICRO)} AS microprice, ask_price - bid_price AS spread,
       {r('(bid_size - ask_size) / (bid_size + ask_size)')} AS queue_imbalance FROM ticks"""))
def quote_features(spark, folder):
    df, _ = table(spark, folder, "ticks")
    return rounded(
        df.select(
            "symbol", "seq", mid_price().alias("mid_price"), weighted_mid().alias("microprice"),
            quoted_spread().alias("spread"), queue_imbalance().alias("queue_imbalance"),
        )
    )


@query(over("ticks", f"""
SELECT symbol, seq, {r(f'2 * CASE WHEN trade_price > {MID} THEN 1 WHEN trade_price < {MID} THEN -1 ELSE 0 END * (trade_price - {MID})')} AS effective,
       2 * abs(trade_price - {MID}) AS effective_unsigned FROM ticks"""))
def effective_spreads(spark, folder):
    df, _ = table(spark, folder, "ticks")
    d = df.withColumns({"mid_price": mid_price(), "direction": trade_side()})
    return rounded(
        d.select("symbol", "seq", effective_spread().alias("effective"), effective_spread(signed=False).alias("effective_unsigned"))
    )


@query(over("ticks", f"""
SELECT symbol, {r('avg(ask_price - bid_price)')} AS mean_quoted,
       {r(f'avg(2 * CASE WHEN trade_price > {MID} THEN 1 WHEN trade_price < {MID} THEN -1 ELSE 0 END * (trade_price - {MID}))')} AS mean_effective
FROM ticks GROUP BY symbol"""))
def mean_spreads(spark, folder):
    df, _ = table(spark, folder, "ticks")
    d = df.withColumns({"mid_price": mid_price(), "direction": trade_side()})
    return rounded(
        d.groupBy("symbol").agg(F.avg(quoted_spread()).alias("mean_quoted"), F.avg(effective_spread()).alias("mean_effective"))
    )


@query(over("ticks", f"""
SELECT symbol, {r('covar_samp(dp, dp1)', 4)} AS serial_cov, {r('CASE WHEN covar_samp(dp, dp1) < 0 THEN 2 * sqrt(-covar_samp(dp, dp1)) END', 4)} AS roll_spread
FROM (SELECT symbol, dp, lag(dp) OVER (PARTITION BY symbol ORDER BY ts, seq) AS dp1 FROM x) GROUP BY symbol""",
    x=f"SELECT symbol, ts, seq, {MID} - lag({MID}) OVER {W} AS dp FROM ticks"))
def roll_spreads(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(trades.roll_spread(df.withColumn("mid_price", mid_price()), axis), 4)


@query(over("ticks", f"SELECT symbol, seq, ask_price - bid_price AS spread, ask_price - bid_price - lag(ask_price - bid_price) OVER {W} AS spread_change FROM ticks"))
def spread_changes(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_spread_change(df.withColumn("spread", quoted_spread()), axis, round_dp=4)
    return d.select("symbol", "seq", "spread", "spread_change")


DEEP = "SELECT symbol, seq, " + ", ".join(
    f"(seq * {31 * n} + {n}) % 997 AS b{n}, (seq * {17 * n} + {5 * n}) % 991 AS a{n}" for n in range(1, 6)
) + " FROM ticks"
DEEP_B = " + ".join(f"{w} * b{n}" for n, w in zip(range(1, 6), ("1.0", "0.8", "0.6", "0.4", "0.2")))
DEEP_A = DEEP_B.replace("b", "a")


@query(over("ticks", f"""
SELECT symbol, seq, CASE WHEN bid + ask = 0 THEN 0.0 ELSE {r('(bid - ask) / (bid + ask)')} END AS queue_imbalance_5level
FROM (SELECT symbol, seq, CAST({DEEP_B} AS DOUBLE) AS bid, CAST({DEEP_A} AS DOUBLE) AS ask FROM d)""", d=DEEP))
def five_level_queue_imbalance(spark, folder):
    df, _ = table(spark, folder, "ticks")
    sizes = {
        f"{s}{n}": (F.col("seq") * (m * n) + k * n) % mod
        for n in range(1, 6) for s, m, k, mod in (("b", 31, 1, 997), ("a", 17, 5, 991))
    }
    value = queue_imbalance_levels([f"b{n}" for n in range(1, 6)], [f"a{n}" for n in range(1, 6)])
    return rounded(df.withColumns(sizes).select("symbol", "seq", value.alias("queue_imbalance_5level")))


BEST = """SELECT *, max(CASE WHEN side = 'buy' THEN price END) OVER w AS bid_price, min(CASE WHEN side = 'sell' THEN price END) OVER w AS ask_price
FROM order_events WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)"""
LEVELS = """SELECT *, sum(quantity) OVER (PARTITION BY symbol, side, price ORDER BY ts, seq) AS standing FROM order_events"""
TOUCH = """SELECT b.symbol, b.ts, b.seq, b.side, b.price, b.quantity, b.bid_price, b.ask_price,
CAST(lb.standing AS BIGINT) AS bid_size, CAST(la.standing AS BIGINT) AS ask_size FROM best b
ASOF LEFT JOIN (SELECT * FROM levels WHERE side = 'buy') lb ON b.symbol = lb.symbol AND b.bid_price = lb.price AND b.ts >= lb.ts
ASOF LEFT JOIN (SELECT * FROM levels WHERE side = 'sell') la ON b.symbol = la.symbol AND b.ask_price = la.price AND b.ts >= la.ts"""
BOOK = {"best": BEST, "levels": LEVELS, "t": TOUCH}


@query(over("order_events", "SELECT * FROM t", **BOOK))
def book_touch(spark, folder):
    df, axis = table(spark, folder, "order_events")
    return orderbook.touch(df, axis)


@query(over("order_events", f"""
SELECT symbol, seq, {MID} AS mid_price, {r(f'CASE WHEN bid_size + ask_size = 0 THEN {MID} ELSE {MICRO} END')} AS weighted_mid,
       {r('CASE WHEN bid_size + ask_size = 0 THEN 0.0 ELSE (bid_size - ask_size) / (bid_size + ask_size) END')} AS queue_imbalance FROM t""", **BOOK))
def book_features(spark, folder):
    df, axis = table(spark, folder, "order_events")
    d = orderbook.touch_features(orderbook.touch(df, axis))
    return rounded(d.select("symbol", "seq", "mid_price", "weighted_mid", "queue_imbalance"))


RESET = """{p}_size - CASE WHEN {p}_price = lag({p}_price) OVER w THEN lag({p}_size) OVER w ELSE 0 END"""


@query(over("order_events", f"""
SELECT symbol, seq, ofi FROM (SELECT symbol, seq, is_seed, {RESET.format(p='bid')} - ({RESET.format(p='ask')}) AS ofi
FROM (SELECT * FROM o WHERE NOT is_seed OR is_base) WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) WHERE NOT is_seed""",
    **BOOK, n="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM t",
    o="SELECT *, i <= 20 AS is_seed, i = 20 AS is_base FROM n"))
def book_order_flow(spark, folder):
    df, axis = table(spark, folder, "order_events")
    seeded = over_rows(lay_out(df, axis), axis, lambda d, w: d.withColumn("is_seed", F.lag("seq", 20).over(w).isNull()), back=20, laid_out=True)
    return orderbook.book_ofi(seeded, axis, laid_out=True).select("symbol", "seq", "ofi")


@query(over("ticks", "SELECT symbol, seq, ofi FROM c", sided=SIDED, c=CONT))
def ofi_cont(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return ofi.with_ofi(df, axis, "cont").select("symbol", "seq", "ofi")


@query(over("ticks", f"""
SELECT symbol, seq, CASE WHEN bid_price = pb THEN bid_size - pbs ELSE bid_size END - CASE WHEN ask_price = pa THEN ask_size - pas ELSE ask_size END AS ofi
FROM sided""", sided=SIDED))
def ofi_reset(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return ofi.with_ofi(df, axis, "reset").select("symbol", "seq", "ofi")


SIGNED = """SELECT *, CASE WHEN bid_price > pb THEN bid_size WHEN bid_price < pb THEN -bid_size WHEN bid_price = pb THEN bid_size - pbs ELSE 0 END
- CASE WHEN ask_price < pa THEN ask_size WHEN ask_price > pa THEN -ask_size WHEN ask_price = pa THEN ask_size - pas ELSE 0 END AS ofi FROM sided"""


@query(over("ticks", "SELECT symbol, seq, ofi FROM s", sided=SIDED, s=SIGNED))
def ofi_signed_current(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return ofi.with_ofi(df, axis, "signed_current").select("symbol", "seq", "ofi")


@query(over("ticks", "SELECT symbol, seq, ofi FROM x", x=SIZE_OFI))
def ofi_size_only(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return ofi.with_ofi(df, axis, "size_only").select("symbol", "seq", "ofi")


@query(over("ticks", f"""
SELECT symbol, seq, {r(f"ofi / nullif({full('stddev_samp', 'ofi', 20)}, 0)")} AS ofi_norm,
       {r(f"ofi / nullif({full('stddev_samp', 'ofi', 20, 1)}, 0)")} AS ofi_norm_prior,
       {r(f"volume / nullif({full('avg', 'volume', 20, 1)}, 0)")} AS volume_norm FROM x""", x=SIZE_OFI))
def normalised_flow(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_normalised(
        ofi.with_ofi(df, axis, "size_only"), axis,
        ofi_norm=dict(x="ofi"), ofi_norm_prior=dict(x="ofi", prior=True), volume_norm=dict(x="volume", by="mean", prior=True),
    )
    return rounded(d.select("symbol", "seq", "ofi_norm", "ofi_norm_prior", "volume_norm"))


@query(over("ticks", f"""
SELECT symbol, {r('avg(ofi)', 4)} AS mean_ofi, {r('stddev_samp(ofi)', 4)} AS std_ofi, {r('100.0 * count(*) FILTER (ofi > 0) / count(ofi)')} AS pct_positive, count(ofi) AS n
FROM c GROUP BY symbol""", sided=SIDED, c=CONT))
def ofi_summary(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(ofi.ofi_summary(ofi.with_ofi(df, axis), axis), mean_ofi=4, std_ofi=4)


SIDE = f"CASE WHEN trade_price > {MID} THEN 1 WHEN trade_price < {MID} THEN -1 ELSE 0 END"


@query(over("ticks", f"""
SELECT symbol, seq, direction, CASE WHEN direction = 1 THEN volume ELSE 0 END AS buy_vol, CASE WHEN direction = -1 THEN volume ELSE 0 END AS sell_vol,
       CASE WHEN n >= 10 AND b + s > 0 THEN {r('(b - s) / (b + s)')} ELSE 0.0 END AS trade_imbalance
FROM (SELECT *, count(*) OVER w AS n, sum(CASE WHEN direction = 1 THEN volume ELSE 0 END) OVER w AS b,
      sum(CASE WHEN direction = -1 THEN volume ELSE 0 END) OVER w AS s FROM d
      WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""",
    d=f"SELECT *, {SIDE} AS direction FROM ticks"))
def trade_imbalance(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = trades.with_trade_imbalance(df, axis).withColumns({c: F.col(c).cast("bigint") for c in ("buy_vol", "sell_vol")})
    return rounded(d.select("symbol", "seq", "direction", "buy_vol", "sell_vol", "trade_imbalance"))


@query(over("ticks", f"SELECT symbol, seq, {r(full('avg', 'sgn', 6))} AS trade_imbalance FROM (SELECT *, sign(trade_price - {MID}) AS sgn FROM ticks)"))
def trade_count_imbalance(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        return d.withColumn("_s", trades.side_sign()).withColumn("trade_imbalance", trades.count_imbalance(w, "_s"))

    return rounded(over_rows(df, axis, build, back=5).select("symbol", "seq", "trade_imbalance"))


@query(over("ticks", f"SELECT symbol, seq, {r(f'sum(trade_price * volume) OVER {W} / sum(volume) OVER {W}')} AS vwap FROM ticks"))
def running_vwap(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(trades.with_vwap(df, axis).select("symbol", "seq", "vwap"))


@query(over("ticks", f"""
SELECT symbol, session_date, seq, {r('sum(trade_price * volume) OVER w / sum(volume) OVER w')} AS vwap
FROM (SELECT *, date_trunc('day', ts) AS session_date FROM ticks) WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts, seq)"""))
def session_vwap(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = df.withColumn("session_date", F.to_date("ts").cast("timestamp_ntz"))
    return rounded(trades.with_vwap(d, axis.by("session_date")).select("symbol", "session_date", "seq", "vwap"))


IMPACT = f"""SELECT *, sign(trade_price - {MID}) * volume AS sv, trade_price / lag(trade_price) OVER {W} - 1 AS ret FROM ticks"""
W20 = "(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
LAMBDA = f"CASE WHEN count(ret) OVER {W20} >= 20 THEN covar_samp(ret, sv) OVER {W20} / nullif(var_samp(sv) OVER {W20}, 0) END"


@query(over("ticks", f"""
SELECT symbol, seq, {r(LAMBDA, 10)} AS kyle_lambda, {r('abs(ret) / nullif(volume, 0)', 10)} AS amihud,
       {r(full('stddev_samp', 'ret', 20), 8)} AS realized_vol FROM x""", x=IMPACT))
def price_impact(spark, folder):
    df, axis = table(spark, folder, "ticks")

    def build(d, w):
        d = d.withColumn("_ret", trades.simple_return("trade_price", w))
        d = d.withColumn("_sv", trades.side_sign() * F.col("volume"))
        return d.withColumns(
            {
                "kyle_lambda": trades.kyle_lambda("_ret", "_sv", w), "amihud": trades.amihud("_ret"),
                "realized_vol": F.when(F.count("_ret").over(w.rowsBetween(-19, 0)) >= 20, F.stddev_samp("_ret").over(w.rowsBetween(-19, 0))),
            }
        )

    d = over_rows(df, axis, build, back=20).select("symbol", "seq", "kyle_lambda", "amihud", "realized_vol")
    return rounded(d, 10, realized_vol=8)


ASOF = """SELECT t.symbol, t.ts, t.seq, t.price, t.volume, q.ts AS quote_ts, q.bid_price, q.ask_price, q.bid_size, q.ask_size
FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"""


@query(over("trades quotes", ASOF))
def trades_with_prevailing_quote(spark, folder):
    t, axis = table(spark, folder, "trades")
    return trades.prevailing_quote(t, table(spark, folder, "quotes")[0], axis)


@query(over("trades quotes", """
SELECT symbol, ts, seq, price, volume, CASE WHEN near THEN quote_ts END AS quote_ts, CASE WHEN near THEN bid_price END AS bid_price,
       CASE WHEN near THEN ask_price END AS ask_price, CASE WHEN near THEN bid_size END AS bid_size, CASE WHEN near THEN ask_size END AS ask_size
FROM (SELECT *, ts - quote_ts <= INTERVAL 20 MINUTE AS near FROM a)""", a=ASOF))
def trades_with_recent_quote(spark, folder):
    t, axis = table(spark, folder, "trades")
    return trades.prevailing_quote(t, table(spark, folder, "quotes")[0], axis, tolerance="20 minutes")
