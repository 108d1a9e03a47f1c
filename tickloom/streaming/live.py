"""Live versions of the tick operators, as Structured Streaming queries.

A stream carries a zoned ``ts`` (a watermark does not take a zone-less one). Every function
takes and returns a streaming DataFrame; rows later than the watermark are dropped by Spark. The keyed streams (OFI, book,
volume bars) take rows in blocks: a block that is late as a whole is dropped by Spark, and a late row among others in time by
the watermark that its symbol last saw, so one of a symbol that was away meanwhile may still count, in its place.
With all rows closed behind the watermark the output equals the batch operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import col
from .ordered import BookProcessor, OfiProcessor, VolumeBarProcessor, blocks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TICK = [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType())]


def _double(*names):
    return [T.StructField(n, T.DoubleType()) for n in names]


def _long(*names):
    return [T.StructField(n, T.LongType()) for n in names]


OFI_OUT = T.StructType(
    [*_TICK, *_double("bid_price", "ask_price"), *_long("bid_size", "ask_size"), *_double("trade_price"), *_long("volume", "ofi")]
)
TOUCH_OUT = T.StructType([*_TICK, *_double("bid_price", "ask_price"), *_long("bid_size", "ask_size", "ofi")])
VOLUME_BAR_OUT = T.StructType(
    [
        _TICK[0], T.StructField("bar_id", T.LongType()), _TICK[1], *_double("open", "high", "low", "close"),
        *_long("total_volume"), *_double("vwap"),
    ]
)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs; call it before starting a stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def zoned(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Read a zone-less time column as UTC (the session zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def clean_stream(
    df: DataFrame, delay: str = "10 minutes", price: str = "price", keys=("symbol",), ts: str = "ts", seq: str = "seq",
) -> DataFrame:
    """The first arrival (lowest ``seq``) per key and time stamp, once the watermark has passed it, bad prices removed."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    first = df.withWatermark(ts, delay).groupBy(*keys, ts).agg(*[F.min_by(c, F.col(seq)).alias(c) for c in rest])
    return first.select(*df.columns).filter(F.col(price) > 0)


def bar_stream(
    df: DataFrame, freq: str = "1 minute", delay: str = "10 minutes", price: str = "price", volume: str = "volume",
    keys=("symbol",), ts: str = "ts", seq: str = "seq",
) -> DataFrame:
    """Time bars, each emitted once the watermark has passed its end."""
    p = col(price)
    at = F.when(p.isNotNull(), F.struct(ts, seq))
    return (
        df.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, freq).alias("_w"))
        .agg(
            F.min_by(p, at).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, at).alias("close"),
            F.coalesce(F.sum(volume), F.lit(0)).alias("volume"),
        )
        .filter(F.col("open").isNotNull())
        .select(*keys, F.col("_w.start").alias("bar_start"), "open", "high", "low", "close", "volume")
    )


def ofi_bar_stream(
    df: DataFrame, freq: str = "1 minute", delay: str = "10 minutes", keys=("symbol",), ts: str = "ts", seq: str = "seq",
) -> DataFrame:
    """OFI bars of a stream that has ``ofi``, ``mid_price``, ``volume`` and ``direction``."""
    at = F.when(F.col("mid_price").isNotNull(), F.struct(ts, seq))
    return (
        df.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, freq).alias("_w"))
        .agg(
            F.coalesce(F.sum("ofi"), F.lit(0)).alias("ofi"), F.max_by("mid_price", at).alias("mid_price"),
            F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.count("direction").alias("n_trades"),
        )
        .filter(F.col("mid_price").isNotNull())
        .select(*keys, F.col("_w.start").alias("bar_start"), "ofi", "mid_price", "volume", "n_trades")
    )


def _keyed(df: DataFrame, processor, out: T.StructType, delay: str, columns: list[str]) -> DataFrame:
    return (
        blocks(df.select("symbol", "ts", "seq", *columns), processor.waiting)
        .withWatermark("ts", delay)
        .groupBy("symbol")
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime",
        )
    )


def ofi_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Tick OFI (``cont``) against the previous quote of the symbol, kept as state."""
    columns = ["bid_price", "ask_price", "bid_size", "ask_size", "trade_price", "volume"]
    return _keyed(df, OfiProcessor(), OFI_OUT, delay, columns)


def book_stream(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Best bid and ask with sizes and OFI after each order event, the book kept as state."""
    if "is_seed" not in df.columns:
        df = df.withColumn("is_seed", F.lit(False))
    return _keyed(df, BookProcessor(), TOUCH_OUT, delay, ["side", "price", "quantity", "is_seed"])


def volume_bar_stream(df: DataFrame, threshold: int = 500, delay: str = "10 minutes") -> DataFrame:
    """Volume bars, each emitted when the next one opens; the open bar is state."""
    return _keyed(df, VolumeBarProcessor(threshold), VOLUME_BAR_OUT, delay, ["price", "volume"])
