"""Market-shaped tables derived from the generic event and order tables.

The bundled data has no quotes, so every column is a fixed function of an event; each table
holds all of them (``dirty`` also late copies, ``trades`` some time after their quotes). Prices sit on
a quarter-point grid, which is exact in binary, so price equality and at-mid tests are exact.
The texts are plain SQL and are also what the checks run in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TICKS_SQL = """
SELECT event_id AS seq, ts, event_type AS symbol,
       CAST(0.25 * CAST(400 + floor(value / 10) AS INT) AS DOUBLE) AS bid_price,
       CAST(0.25 * CAST(400 + floor(value / 10) + 1 + event_id % 3 AS INT) AS DOUBLE) AS ask_price,
       CAST(100 + (user_id * 37) % 900 AS BIGINT) AS bid_size,
       CAST(100 + (event_id * 7919) % 900 AS BIGINT) AS ask_size,
       CAST(0.25 * CAST(400 + floor(value / 10) + event_id % 4 AS INT) AS DOUBLE) AS trade_price,
       CAST(50 + (event_id * 31) % 450 AS BIGINT) AS volume
FROM events
"""

DIRTY_SQL = """
SELECT event_type AS symbol, ts, event_id * 2 AS seq,
       CASE WHEN event_id % 97 = 0 THEN NULL
            WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE)
            WHEN event_id % 103 = 0 THEN CAST(-10 AS DOUBLE)
            ELSE CAST(0.25 * CAST(400 + floor(value / 10) + event_id % 4 AS INT) AS DOUBLE) END AS price,
       CASE WHEN event_id % 1009 = 0 THEN CAST(999999 AS BIGINT)
            WHEN event_id % 109 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(50 + (event_id * 31) % 450 AS BIGINT) END AS volume
FROM events
UNION ALL
SELECT event_type AS symbol, ts, event_id * 2 + 1 AS seq, CAST(1 AS DOUBLE) AS price, CAST(7 AS BIGINT) AS volume
FROM events WHERE event_id % 50 = 0
"""

QUOTES_SQL = """
SELECT event_type AS symbol, ts, event_id AS seq,
       CAST(0.25 * CAST(400 + floor(value / 10) AS INT) AS DOUBLE) AS bid_price,
       CAST(0.25 * CAST(400 + floor(value / 10) + 1 + event_id % 3 AS INT) AS DOUBLE) AS ask_price,
       CAST(100 + (user_id * 37) % 900 AS BIGINT) AS bid_size,
       CAST(100 + (event_id * 7919) % 900 AS BIGINT) AS ask_size
FROM events
"""

TRADES_SQL = """
SELECT event_type AS symbol, ts + (event_id % 7) * INTERVAL '150' SECOND AS ts, event_id AS seq,
       CAST(0.25 * CAST(400 + floor(value / 10) + event_id % 4 AS INT) AS DOUBLE) AS price,
       CAST(50 + (event_id * 31) % 450 AS BIGINT) AS volume
FROM events
"""

ORDERS_SQL = """
SELECT event_type AS symbol, ts, event_id AS seq,
       CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
       CASE WHEN event_id % 2 = 0 THEN CAST(100 - CAST(floor(value / 25) AS INT) % 12 + event_id // 2500 AS DOUBLE)
            ELSE CAST(140 + CAST(floor(value / 25) AS INT) % 12 - event_id // 2500 AS DOUBLE) END AS price,
       CAST(50 + (event_id * 31) % 450 AS BIGINT) AS quantity
FROM events
"""

DAILY_SQL = """
SELECT o_orderpriority AS symbol, o_orderdate AS date,
       CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS DOUBLE) AS close,
       CAST(count(*) AS BIGINT) AS volume
FROM orders GROUP BY o_orderpriority, o_orderdate
"""

STRATEGIES_SQL = """
SELECT CAST(user_id % 20 AS INT) AS strategy_id, event_id AS obs_id,
       CAST((event_id * 7919) % 2001 - 1000 - (user_id % 20) * 2 AS DOUBLE) AS ret
FROM events
"""

MARKET_SQL = {
    "ticks": TICKS_SQL, "dirty": DIRTY_SQL, "quotes": QUOTES_SQL, "trades": TRADES_SQL,
    "order_events": ORDERS_SQL, "daily": DAILY_SQL, "strategies": STRATEGIES_SQL,
}


def market_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of ``MARKET_SQL``'s tables over the Parquet files of a data folder."""
    source = "orders" if name == "daily" else "events"
    text = MARKET_SQL[name].replace("//", "div")
    return spark.sql(text.replace(f"FROM {source}", "FROM {src}"), src=spark.read.parquet(f"{folder}/{source}.parquet"))
