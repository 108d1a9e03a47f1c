"""Canonical tables. Zone-less times in batch; streams carry zoned ones for their watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null


_TYPES = {
    "STRING": T.StringType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "BIGINT": T.LongType(), "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(), "DATE": T.DateType(),
}


def _table(text: str) -> T.StructType:
    """Schema of ``name TYPE, ...``, without the running session that parsing DDL needs."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))])


_QUOTE = "bid_price DOUBLE, ask_price DOUBLE, bid_size BIGINT, ask_size BIGINT"
_TICK = "symbol STRING, ts TIMESTAMP_NTZ, seq BIGINT"

QUOTES = _table(f"{_TICK}, {_QUOTE}")
DEEP_QUOTES = _table(
    f"{_TICK}, {_QUOTE}, " + ", ".join(f"{s}_size_l{n} BIGINT" for n in range(2, 6) for s in ("bid", "ask"))
)
TRADES = _table(f"{_TICK}, price DOUBLE, volume BIGINT")
TICKS_TABLE = _table(f"{_TICK}, {_QUOTE}, trade_price DOUBLE, volume BIGINT, direction INT")
ORDER_EVENTS = _table(f"{_TICK}, side STRING, price DOUBLE, quantity BIGINT")
DAILY_BARS = _table("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT")
STRATEGY_RETURNS = _table("strategy_id INT, obs_id INT, ret DOUBLE")


def conform(df: DataFrame, schema: T.StructType, names: dict[str, str] | None = None) -> DataFrame:
    """Rename columns to a canonical table, cast them to its types and turn NaN into NULL."""
    df = df.withColumnsRenamed(names or {})
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return nan_to_null(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
