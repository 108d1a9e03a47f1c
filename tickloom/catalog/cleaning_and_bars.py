"""Tick cleaning, time, OFI and volume bars, month sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mid_price, trade_side
from ..operators import bars, clean, ofi, stats
from ..plans import running
from .base import W, over, query, r, rounded, table
from .selection import RET, daily_returns

#: Horizons that suit the bundled events (one event in about four minutes at the middle size).
HORIZONS = {"1h": "1 hour", "6h": "6 hours", "1d": "1 day"}

UNIQUE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS rn,
count(*) OVER (PARTITION BY symbol, ts) AS copies FROM dirty) WHERE rn = 1"""
GOOD = "SELECT * FROM u WHERE price > 0"
FAIR = """SELECT symbol, ts, seq, price, volume FROM g
JOIN (SELECT symbol, avg(volume) + 5 * stddev_samp(volume) AS cap FROM g GROUP BY symbol) USING (symbol)
WHERE volume > 0 AND volume < cap"""
SPINE = """SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM
(SELECT symbol, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM f GROUP BY symbol)"""
GRID = "SELECT s.symbol, s.ts, f.seq, f.price, f.volume FROM s ASOF LEFT JOIN f ON s.symbol = f.symbol AND s.ts >= f.ts"


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM u", u=UNIQUE))
def first_arrivals(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return clean.first_arrivals(df, axis)


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM d", u=UNIQUE, g=GOOD, f=FAIR, s=SPINE, d=GRID))
def clean_hourly_grid(spark, folder):
    df, axis = table(spark, folder, "dirty")
    grid = clean.clean_ticks(df, axis, step="1 hour")[0]
    return grid.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


AUDIT = """
SELECT symbol, CAST(sum(copies) AS BIGINT) AS rows_in, CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
       count(*) FILTER (NOT ok) AS bad_prices_removed, count(*) FILTER (ok AND price IS NULL) AS prices_ffilled,
       count(*) FILTER (ok AND NOT fair) AS bad_volume_removed,
       CAST(date_diff('hour', min(CASE WHEN ok AND fair THEN ts END), max(CASE WHEN ok AND fair THEN ts END)) + 1 AS BIGINT) AS rows_out
FROM (SELECT *, volume > 0 AND volume < cap AS fair FROM g JOIN
      (SELECT symbol, avg(volume) + 5 * stddev_samp(volume) AS cap FROM g WHERE ok GROUP BY symbol) USING (symbol))
GROUP BY symbol"""


@query(over("dirty", AUDIT, u=UNIQUE, g="SELECT *, coalesce(price > 0, false) AS ok FROM u"))
def clean_audit(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return clean.clean_ticks(df, axis, step="1 hour")[1]


@query(over("dirty", AUDIT, u=UNIQUE, g="SELECT *, coalesce(price > 0, true) AS ok FROM u"))
def clean_audit_with_fill(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return clean.clean_ticks(df, axis, step="1 hour", gap_policy="ffill")[1]


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM d", u=UNIQUE,
    g=f"SELECT symbol, ts, seq, volume, last_value(price IGNORE NULLS) OVER {W} AS price FROM u WHERE coalesce(price > 0, true)",
    f=FAIR, s=SPINE, d=GRID))
def clean_grid_with_fill(spark, folder):
    df, axis = table(spark, folder, "dirty")
    grid = clean.clean_ticks(df, axis, step="1 hour", gap_policy="ffill")[0]
    return grid.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(over("dirty", f"SELECT symbol, ts, seq, last_value(price IGNORE NULLS) OVER {W} AS filled FROM u", u=UNIQUE))
def forward_filled_prices(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return running(clean.first_arrivals(df, axis), axis, filled=("last", "price")).select("symbol", "ts", "seq", "filled")


@query(over("dirty", """
SELECT symbol, date_trunc('hour', ts) AS bar_start, first(price ORDER BY ts, seq) FILTER (price IS NOT NULL) AS open,
       max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) FILTER (price IS NOT NULL) AS close,
       CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume
FROM dirty GROUP BY ALL HAVING max(price) IS NOT NULL"""))
def hourly_bars(spark, folder):
    df, axis = table(spark, folder, "dirty")
    return bars.time_bars(df, axis, "1 hour")


SIDED = """SELECT *, (bid_price + ask_price) / 2 AS mid_price, CASE WHEN trade_price > (bid_price + ask_price) / 2 THEN 1
WHEN trade_price < (bid_price + ask_price) / 2 THEN -1 ELSE 0 END AS direction,
lag(bid_price) OVER w AS pb, lag(ask_price) OVER w AS pa, lag(bid_size) OVER w AS pbs, lag(ask_size) OVER w AS pas
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)"""
CONT = """SELECT *, coalesce(CASE WHEN bid_price > pb THEN bid_size WHEN bid_price = pb THEN bid_size - pbs ELSE -pbs END
- CASE WHEN ask_price < pa THEN ask_size WHEN ask_price = pa THEN ask_size - pas ELSE -pas END, 0) AS ofi FROM sided"""
BARS = "\nUNION ALL\n".join(
    f"""SELECT symbol, '{h}' AS horizon, time_bucket(INTERVAL '{n}', ts) AS bar_start, CAST(sum(ofi) AS BIGINT) AS ofi,
arg_max(mid_price, ts) AS mid_price, CAST(sum(volume) AS BIGINT) AS volume, count(direction) AS n_trades
FROM c GROUP BY symbol, time_bucket(INTERVAL '{n}', ts)"""
    for h, n in HORIZONS.items()
)
BH = "(PARTITION BY symbol, horizon ORDER BY bar_start)"


def signals_sql(skip: int) -> str:
    start = f"lead(mid_price, {skip}) OVER {BH}" if skip else "mid_price"
    return f"""SELECT * FROM (SELECT symbol, horizon, bar_start, ofi, mid_price, volume, n_trades,
ofi / nullif(volume, 0) AS ofi_norm, lead(mid_price, {skip + 1}) OVER {BH} / ({start}) - 1 AS forward_return,
lag(ofi) OVER {BH} AS ofi_lag1, lag(ofi / nullif(volume, 0)) OVER {BH} AS ofi_norm_lag1 FROM b)
WHERE ofi_norm IS NOT NULL AND forward_return IS NOT NULL AND ofi_lag1 IS NOT NULL AND ofi_norm_lag1 IS NOT NULL"""


STEPS = {"sided": SIDED, "c": CONT, "b": BARS}
SIGNALS = STEPS | {"g": signals_sql(1)}
SIGNAL_COLUMNS = f"""symbol, horizon, bar_start, ofi, mid_price, volume, n_trades, {r('ofi_norm')} AS ofi_norm,
{r('forward_return')} AS forward_return, ofi_lag1, {r('ofi_norm_lag1')} AS ofi_norm_lag1"""


def ofi_bars(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = ofi.with_ofi(df, axis, "cont").withColumns({"mid_price": mid_price(), "direction": trade_side()})
    return bars.ofi_bars(d, axis, HORIZONS), bars.bar_axis(axis)


def ofi_signals(spark, folder, forward_skip: int = 1):
    b, axis = ofi_bars(spark, folder)
    return bars.bar_signals(b, axis, forward_skip), axis


@query(over("ticks", "SELECT * FROM b", **STEPS))
def ofi_bars_by_horizon(spark, folder):
    return ofi_bars(spark, folder)[0]


@query(over("ticks", f"SELECT {SIGNAL_COLUMNS} FROM g", **SIGNALS))
def ofi_bar_signals(spark, folder):
    return rounded(ofi_signals(spark, folder)[0])


@query(over("ticks", f"SELECT {SIGNAL_COLUMNS} FROM g", **(STEPS | {"g": signals_sql(0)})))
def ofi_bar_signals_next_bar(spark, folder):
    return rounded(ofi_signals(spark, folder, 0)[0])


VB = f"SELECT *, CAST(floor(sum(volume) OVER {W} / 500) AS BIGINT) AS bar_id FROM ticks"
VBARS = """SELECT symbol, bar_id, max(ts) AS ts, arg_min(trade_price, ts) AS open, max(trade_price) AS high, min(trade_price) AS low,
arg_max(trade_price, ts) AS close, CAST(sum(volume) AS BIGINT) AS total_volume, sum(trade_price * volume) / sum(volume) AS vwap
FROM v GROUP BY symbol, bar_id"""


@query(over("ticks", "SELECT symbol, seq, bar_id FROM v", v=VB))
def volume_bar_ids(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return bars.volume_bar_ids(df, axis).select("symbol", "seq", "bar_id")


@query(over("ticks", f"SELECT symbol, bar_id, ts, open, high, low, close, total_volume, {r('vwap')} AS vwap FROM vb", v=VB, vb=VBARS))
def volume_bars(spark, folder):
    df, axis = table(spark, folder, "ticks")
    return rounded(bars.volume_bars(df, axis, price="trade_price", keep_id=True))


@query(over("ticks", f"""
SELECT symbol, bar_type, {r('avg(volume)')} AS mean_volume, {r('stddev_samp(volume)')} AS std_volume,
       {r('stddev_samp(volume) / avg(volume)')} AS cv, count(volume) AS n_bars
FROM (SELECT symbol, 'volume' AS bar_type, total_volume AS volume FROM vb UNION ALL
      SELECT symbol, 'time', sum(volume) FROM ticks GROUP BY symbol, date_trunc('hour', ts)) GROUP BY symbol, bar_type""", v=VB, vb=VBARS))
def bar_uniformity(spark, folder):
    df, axis = table(spark, folder, "ticks")
    vb = bars.volume_bars(df, axis, price="trade_price")
    tb = bars.time_bars(df, axis, "1 hour", price="trade_price")
    return rounded(bars.bar_uniformity({"volume": (vb, "total_volume"), "time": (tb, "volume")}, axis))


GRID_BARS = {
    "v": "SELECT *, CAST(floor(sum(volume) OVER (PARTITION BY symbol ORDER BY ts) / 500) AS BIGINT) AS bar_id FROM d",
    "vb": "SELECT symbol, bar_id, CAST(sum(volume) AS BIGINT) AS volume FROM v GROUP BY ALL",
    "tb": "SELECT symbol, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume FROM d GROUP BY symbol, time_bucket(INTERVAL '6 hours', ts) HAVING max(price) IS NOT NULL",
}


@query(over("dirty", f"""
SELECT symbol, bar_type, {r('avg(volume)')} AS mean_volume, {r('stddev_samp(volume)')} AS std_volume,
       {r('stddev_samp(volume) / avg(volume)')} AS cv, count(volume) AS n_bars
FROM (SELECT symbol, 'volume' AS bar_type, volume FROM vb UNION ALL SELECT symbol, 'time', volume FROM tb) GROUP BY symbol, bar_type""",
    u=UNIQUE, g=GOOD, f=FAIR, s=SPINE, d=GRID, **GRID_BARS))
def clean_bars(spark, folder):
    """Dirty ticks to a clean grid, to volume and time bars, to their uniformity; bars use the grid's own size."""
    df, axis = table(spark, folder, "dirty")
    grid = clean.clean_ticks(df, axis, step="1 hour", utc=False)[0]
    axis = axis.measured(grid)
    vb, tb = bars.volume_bars(grid, axis), bars.time_bars(grid, axis, "6 hours")
    return rounded(bars.bar_uniformity({"volume": (vb, "total_volume"), "time": (tb, "volume")}, axis))


MONTHS = """SELECT symbol, CAST(last_day(m) AS TIMESTAMP) AS month_end, coalesce(t, 0) AS total FROM
(SELECT symbol, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM mm GROUP BY symbol) LEFT JOIN mm USING (symbol, m)"""
MONTHLY = "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS m, sum(ret) AS t FROM x GROUP BY ALL"


def _at_midnight(df, *dates):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates})


def _monthly(spark, folder):
    df, axis = daily_returns(spark, folder)
    return bars.month_sums(df, axis), axis


@query(over("daily", f"SELECT symbol, month_end, {r('total')} AS total FROM mo", x=RET, mm=MONTHLY, mo=MONTHS))
def month_sums(spark, folder):
    return rounded(_at_midnight(_monthly(spark, folder)[0], "month_end"))


@query(over("daily", f"""
SELECT symbol, first(month_end ORDER BY total, month_end) AS worst_month, {r('min(total)')} AS worst,
       first(month_end ORDER BY total DESC, month_end) AS best_month, {r('max(total)')} AS best FROM mo GROUP BY symbol""", x=RET, mm=MONTHLY, mo=MONTHS))
def month_extremes(spark, folder):
    months, axis = _monthly(spark, folder)
    return rounded(_at_midnight(bars.month_extremes(months, axis), "worst_month", "best_month"))


@query(over("ticks", f"""
SELECT symbol, CAST(i AS INTEGER) AS bin, coalesce(c, 0) AS count, {r('lo + i * w')} AS left_edge
FROM (SELECT *, unnest(range(20)) AS i FROM e) LEFT JOIN
     (SELECT symbol, least(CAST(floor((total_volume - lo) / w) AS BIGINT), 19) AS i, count(*) AS c FROM vb JOIN e USING (symbol) GROUP BY ALL)
     USING (symbol, i)""", v=VB, vb=VBARS,
    e="SELECT symbol, CAST(min(total_volume) AS DOUBLE) AS lo, (max(total_volume) - min(total_volume)) / 20.0 AS w FROM vb GROUP BY symbol"))
def volume_bar_histogram(spark, folder):
    df, axis = table(spark, folder, "ticks")
    vb = bars.volume_bars(df, axis, price="trade_price")
    return rounded(stats.histogram(vb, axis, "total_volume", bins=20, density=False))
