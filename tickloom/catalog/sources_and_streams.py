"""Landed files in all their forms, and live operators run over a file stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import bars, daily
from ..plans.layout import shared_folder
from ..sources import conform, flatten_header, read_bars, read_csv, read_minute_bars, with_session_date, write_csv, write_parquet
from ..sources.schemas import DAILY_BARS
from .base import W, over, query, r, rounded, table
from .books_and_flow import BOOK
from .cleaning_and_bars import CONT, GOOD, GRID, SIDED, SPINE, UNIQUE, VBARS


def _scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tickloom-{kind}-{uuid.uuid4().hex}"


@query(over("daily", "SELECT symbol, CAST(date AS DATE) AS date, close, volume FROM daily WHERE symbol IN ('1-URGENT', '2-HIGH') AND date >= DATE '1996-01-01' AND date < DATE '1999-01-01'"))
def landed_daily_bars(spark, folder):
    df = table(spark, folder, "daily")[0].withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low")})
    path = write_parquet(conform(df, DAILY_BARS), _scratch(spark, "landed"))
    found = read_bars(spark, path, ["1-URGENT", "2-HIGH"], date(1996, 1, 1), date(1999, 1, 1))
    return found.select("symbol", "date", "close", "volume")


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM dirty WHERE price IS NOT NULL AND volume IS NOT NULL"))
def complete_minute_bars(spark, folder):
    return read_minute_bars(spark, write_parquet(table(spark, folder, "dirty")[0], _scratch(spark, "minutes")))


@query(over("daily", "SELECT symbol, CAST(date AS DATE) AS date, close FROM daily"))
def csv_with_written_dates(spark, folder):
    df = table(spark, folder, "daily")[0].select("symbol", F.date_format("date", "dd/MM/yyyy").alias("date"), "close")
    return read_csv(spark, write_csv(df, _scratch(spark, "dates")), "symbol STRING, date DATE, close DOUBLE", date_format="dd/MM/yyyy")


@query(over("daily", 'SELECT date, close AS "Close", volume AS "Volume" FROM daily WHERE symbol = \'1-URGENT\''))
def flattened_header(spark, folder):
    df = table(spark, folder, "daily")[0].filter("symbol = '1-URGENT'")
    return flatten_header(df.select("date", F.col("close").alias("Close_URGENT"), F.col("volume").alias("Volume_URGENT")))


@query(over("ticks", f"SELECT symbol, seq, greatest(CAST(0 AS BIGINT), max(raw) OVER {W}) AS bar_id FROM b",
    b=f"SELECT symbol, ts, seq, CAST(floor(sum(CASE WHEN seq % 3 = 0 THEN -volume ELSE volume END) OVER {W} / 500) AS BIGINT) AS raw FROM ticks"))
def signed_volume_bar_ids(spark, folder):
    df, axis = table(spark, folder, "ticks")
    d = df.withColumn("flow", F.when(F.col("seq") % 3 == 0, -F.col("volume")).otherwise(F.col("volume")))
    return bars.volume_bar_ids(d, axis, volume="flow", signed=True).select("symbol", "seq", "bar_id")


FAIR_BY_DATE = """SELECT symbol, ts, seq, price, volume FROM g JOIN (SELECT symbol, CAST(ts AS DATE) AS day,
avg(volume) + 5 * stddev_samp(volume) AS cap FROM g GROUP BY ALL) c ON g.symbol = c.symbol AND CAST(g.ts AS DATE) = c.day
WHERE volume > 0 AND volume < cap"""


@query(over("dirty", "SELECT symbol, ts, seq, price, volume, CAST(ts AS DATE) AS session_date FROM d", u=UNIQUE, g=GOOD,
    f=FAIR_BY_DATE.replace("SELECT symbol, ts", "SELECT g.symbol, ts", 1), s=SPINE, d=GRID))
def late_file_of_one_date(spark, folder):
    """All dates are cleaned, a third of the middle date's ticks arrive late, and that date is cleaned again."""
    ticks = with_session_date(table(spark, folder, "dirty")[0])
    first, last = ticks.agg(F.min("session_date"), F.max("session_date")).first()
    middle = first + (last - first) // 2
    late = (F.col("session_date") == F.lit(middle)) & (F.col("seq") % 3 == 0)
    landed, store = _scratch(spark, "landed"), _scratch(spark, "store")
    raw = lambda: daily.stored(spark, landed, ticks.schema)
    write_parquet(ticks.where(~late), landed, ("session_date",))
    daily.clean_dates(raw(), store, first, last, step="1 hour")
    write_parquet(ticks.where(late), landed, ("session_date",), mode="append")
    daily.clean_dates(raw(), store, middle, middle, step="1 hour")
    return daily.stored(spark, f"{store}/grid", ticks.schema)


#: After every bundled row by more than any delay; rows from here on only move the watermark.
END = "2090-01-01"
DELAY = "10 minutes"
FILES = 4


def _live(spark: SparkSession, df: DataFrame, build: Callable[[DataFrame], DataFrame], kind: str, time: str = "ts") -> DataFrame:
    """What ``build`` has emitted when a stream of ``df`` from files has ended and its watermark has passed every row."""
    streaming.use_rocksdb(spark)
    source, sink = _scratch(spark, f"{kind}-in"), _scratch(spark, f"{kind}-out")
    last = df.groupBy("symbol").agg(*[F.max(c).alias(c) for c in df.columns if c not in ("symbol", "ts")])

    def at_end(days: int) -> DataFrame:
        ts = F.lit(END).cast("timestamp_ntz") + F.expr(f"make_dt_interval({days})")
        return last.withColumns({"ts": ts, "seq": F.col("seq") + 1 + days}).select(*df.columns)

    # the first row of the end waits with the data, and the second, in a later batch, moves the watermark past it
    df.unionByName(at_end(0)).repartition(FILES, F.xxhash64("seq")).write.parquet(source)
    at_end(1).coalesce(1).write.mode("append").parquet(source)
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).option("latestFirst", "false").parquet(source)
    run = (
        build(streaming.zoned(live)).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", _scratch(spark, f"{kind}-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    out = spark.read.parquet(sink)
    return out.withColumn(time, F.col(time).cast("timestamp_ntz")).filter(F.col(time) < F.lit(END).cast("timestamp_ntz"))


@query(over("dirty", "SELECT symbol, ts, seq, price, volume FROM u WHERE price > 0", u=UNIQUE))
def live_first_arrivals(spark, folder):
    return _live(spark, table(spark, folder, "dirty")[0], lambda s: streaming.clean_stream(s, DELAY), "clean")


@query(over("dirty", """
SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS bar_start, first(price ORDER BY ts, seq) FILTER (price IS NOT NULL) AS open,
       max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) FILTER (price IS NOT NULL) AS close,
       CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume
FROM dirty GROUP BY ALL HAVING max(price) IS NOT NULL"""))
def live_bars(spark, folder):
    return _live(spark, table(spark, folder, "dirty")[0], lambda s: streaming.bar_stream(s, "6 hours", DELAY), "bars", "bar_start")


@query(over("ticks", "SELECT symbol, ts, seq, CAST(ofi AS BIGINT) AS ofi FROM c", sided=SIDED, c=CONT))
def live_ofi(spark, folder):
    return _live(spark, table(spark, folder, "ticks")[0], lambda s: streaming.ofi_stream(s, DELAY), "ofi").select("symbol", "ts", "seq", "ofi")


@query(over("order_events", "SELECT symbol, ts, seq, bid_price, ask_price, bid_size, ask_size FROM t", **BOOK))
def live_touch(spark, folder):
    out = _live(spark, table(spark, folder, "order_events")[0], lambda s: streaming.book_stream(s, DELAY), "touch")
    return out.select("symbol", "ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size")


@query(over("ticks", f"SELECT symbol, bar_id, ts, open, high, low, close, total_volume, {r('vwap')} AS vwap FROM vb",
    v=f"SELECT *, CAST(floor(sum(volume) OVER {W} / 500) AS BIGINT) AS bar_id FROM ticks", vb=VBARS))
def live_volume_bars(spark, folder):
    ticks = table(spark, folder, "ticks")[0].select("symbol", "ts", "seq", F.col("trade_price").alias("price"), "volume")
    # the row that ends a stream must open a bar of its own, or the last one stays open
    ticks = ticks.withColumn("_bulk", F.lit(1000).cast("bigint"))
    closing = lambda s: s.withColumn("volume", F.when(F.col("ts") >= F.lit(END).cast("timestamp"), F.col("_bulk")).otherwise(F.col("volume"))).drop("_bulk")
    return rounded(_live(spark, ticks, lambda s: streaming.volume_bar_stream(closing(s), delay=DELAY), "volume"))
