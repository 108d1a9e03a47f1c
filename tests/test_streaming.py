"""A stream must give what the batch operator gives, on rows closed behind the watermark."""

import pytest
from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.functions import mid_price, trade_side
from tickloom.operators import bars, clean, ofi, orderbook
from tickloom.sources import market_table
from tickloom.streaming.ordered import BUCKET_US, WaitingRows

LATE = "2 hours"


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    streaming.use_rocksdb(spark)


def stored(spark, df, path, files=6):
    """Write the table as several files in time order, shuffled inside, plus a late sentinel file."""
    step = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / (5 * 86400 * 1000000))
    for i in range(files):
        df.filter(step == i).orderBy(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(path)
    sentinel = df.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.lit("2024-06-01").cast("timestamp_ntz"))
    for seq in (10**9, 10**9 + 1):
        shifted = sentinel.withColumn("ts", F.col("ts") + F.expr(f"make_dt_interval({seq - 10**9 + 1})"))
        symbols = df.select("symbol").distinct().crossJoin(shifted.drop("symbol")).withColumn("seq", F.lit(seq).cast("bigint"))
        symbols.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return df


def run(spark, build, schema, path, tmp_path, name):
    source = streaming.zoned(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    )
    q = (
        build(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    )
    try:
        assert q.awaitTermination(240), "stream did not finish"
    finally:
        q.stop()
    return spark.table(name)


def rows_of(df, columns, before="2024-01-30"):
    kept = df.filter(F.col(columns[1]) < F.lit(before).cast(df.schema[columns[1]].dataType))
    return sorted(
        tuple(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else round(v, 9) if isinstance(v, float) else v for v in row)
        for row in kept.select(*[F.col(c).cast("timestamp_ntz") if c in ("ts", "bar_start") else F.col(c) for c in columns]).collect()
    )


def key(row):
    return tuple(str(v) for v in row)


def check(streamed, batch, columns):
    got, want = sorted(rows_of(streamed, columns), key=key), sorted(rows_of(batch, columns), key=key)
    assert got and got == want


def test_clean_stream(spark, folder, tmp_path):
    dirty = clean.first_arrivals(market_table(spark, folder, "dirty"))
    twice = dirty.unionByName(dirty)
    path = str(tmp_path / "in")
    stored(spark, twice, path)
    out = run(spark, lambda s: streaming.clean_stream(s, LATE), dirty.schema, path, tmp_path, "live_clean")
    check(out, dirty.filter("price > 0"), ["symbol", "ts", "price", "volume"])


def test_bar_stream(spark, folder, tmp_path):
    ticks = market_table(spark, folder, "dirty")
    path = str(tmp_path / "in")
    stored(spark, ticks, path)
    out = run(spark, lambda s: streaming.bar_stream(s, "6 hours", LATE), ticks.schema, path, tmp_path, "live_bars")
    check(out, bars.time_bars(ticks, freq="6 hours"), ["symbol", "bar_start", "open", "high", "low", "close", "volume"])


def test_ofi_stream(spark, folder, tmp_path):
    ticks = market_table(spark, folder, "ticks").select(
        "symbol", "ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size", "trade_price", "volume"
    )
    path = str(tmp_path / "in")
    stored(spark, ticks, path)
    out = run(spark, lambda s: streaming.ofi_stream(s, LATE), ticks.schema, path, tmp_path, "live_ofi")
    check(out, ofi.with_ofi(ticks), ["symbol", "ts", "seq", "ofi"])


def test_ofi_bar_stream(spark, folder, tmp_path):
    ticks = ofi.with_ofi(market_table(spark, folder, "ticks")).withColumns({"mid_price": mid_price(), "direction": trade_side()})
    path = str(tmp_path / "in")
    stored(spark, ticks, path)
    out = run(spark, lambda s: streaming.ofi_bar_stream(s, "1 day", LATE), ticks.schema, path, tmp_path, "live_ofi_bars")
    check(out, bars.ofi_bars(ticks, horizons={"1d": "1 day"}), ["symbol", "bar_start", "ofi", "mid_price", "volume", "n_trades"])


def test_book_stream(spark, folder, tmp_path):
    events = market_table(spark, folder, "order_events").withColumn("is_seed", F.col("ts") < "2024-01-02")
    path = str(tmp_path / "in")
    stored(spark, events, path)
    out = run(spark, lambda s: streaming.book_stream(s, LATE), events.schema, path, tmp_path, "live_book")
    check(out, orderbook.book_ofi(events), ["symbol", "ts", "seq", "bid_price", "ask_price", "bid_size", "ask_size", "ofi"])


def test_volume_bar_stream(spark, folder, tmp_path):
    ticks = market_table(spark, folder, "trades")
    path = str(tmp_path / "in")
    stored(spark, ticks, path)
    out = run(spark, lambda s: streaming.volume_bar_stream(s, 500, LATE), ticks.schema, path, tmp_path, "live_volume_bars")
    batch = bars.volume_bars(ticks, threshold=500, keep_id=True)
    check(out, batch, ["symbol", "ts", "bar_id", "open", "high", "low", "close", "total_volume", "vwap"])


class _Map:
    """A map state that counts the rows read from it."""

    def __init__(self):
        self.held, self.read = {}, 0

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        value = self.held[key]
        self.read += len(value[0]) if isinstance(value[0], list) else 0
        return value

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))


class _Handle:
    def getMapState(self, name, key, value):
        return _Map()


def test_a_timer_reads_the_rows_that_are_due():
    """Rows of an hour wait; each timer reads those of its own ten seconds, not all that wait."""
    waiting = WaitingRows(_Handle(), "us bigint, seq bigint, price double")
    rows = [(i * 100_000, i, float(i)) for i in range(36_000)]
    for start in range(0, len(rows), 7_000):
        waiting.add(rows[start : start + 7_000][::-1])
    out, most = [], 0
    for until in range(0, 3_600_000_001, 5_000_000):
        before = waiting.rows.read
        out += waiting.take(until)
        most = max(most, waiting.rows.read - before)
    assert out == rows and not waiting.rows.held and not waiting.parts.held
    assert most <= 100 and waiting.rows.read <= 1.6 * len(rows)


def test_late_parts_of_a_bucket_come_in_order():
    waiting = WaitingRows(_Handle(), "us bigint, seq bigint")
    waiting.add([(25, 2), (5, 1), (BUCKET_US + 1, 3)])
    waiting.add([(5, 0), (-3, 9)])
    assert waiting.take(25) == [(-3, 9), (5, 0), (5, 1)]
    assert waiting.take(25) == [] and waiting.take(BUCKET_US + 2) == [(25, 2), (BUCKET_US + 1, 3)]
