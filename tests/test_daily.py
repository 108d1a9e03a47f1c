"""Cleaning by session date: any order of dates gives the table of one run over all of them."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import daily

SCHEMA = "symbol string, ts timestamp_ntz, seq long, price double, volume long"
FIRST = date(2024, 3, 1)


def ticks(spark, rows):
    """(symbol, day, hour, seq, price, volume)"""
    made = [(s, day, hour, seq, p, v) for s, day, hour, seq, p, v in rows]
    df = spark.createDataFrame(made, "symbol string, day int, hour double, seq long, price double, volume long")
    ts = F.expr(f"TIMESTAMP_NTZ '{FIRST} 00:00:00' + make_dt_interval(day, 0, 0, CAST(hour * 3600 AS DECIMAL(18, 6)))")
    return df.select("symbol", ts.alias("ts"), "seq", "price", "volume", F.to_date(ts).alias("session_date"))


def grid(spark, store, df):
    return sorted(map(str, daily.stored(spark, f"{store}/grid", df.schema).collect()))


def day(k):
    return FIRST + timedelta(days=k)


ROWS = [
    *[("a", k, h + 0.3, 100 * k + h, 10.0 + k, 5 + h) for k in (0, 1, 2, 5, 6) for h in (1, 9, 20)],
    *[("b", k, h + 0.7, 100 * k + h, 20.0 + k, 7 + h) for k in (1, 6) for h in (0, 23)],
    ("c", 3, 4.0, 1, 30.0, 9), ("c", 3, 5.0, 2, 31.0, 11), ("a", 1, 9.3, 999, 50.0, 1), ("a", 2, 12.0, 7, None, 4), ("b", 6, 2.0, 8, -1.0, 4),
]
LATE = [("a", 2, 23.5, 900, 77.0, 6), ("b", 2, 3.5, 901, 78.0, 6), ("b", 2, 4.5, 902, 78.5, 8), ("a", 2, 1.3, 1, 79.0, 0)]


def test_late_ticks_give_the_table_of_one_run(spark, tmp_path):
    before, after = ticks(spark, ROWS), ticks(spark, ROWS + LATE)
    whole, store = str(tmp_path / "whole"), str(tmp_path / "store")
    daily.clean_dates(after, whole, day(0), day(6), step="1 hour")
    daily.clean_dates(before, store, day(0), day(6), step="1 hour")
    assert grid(spark, store, after) != grid(spark, whole, after)
    untouched = {f for f in os.listdir(f"{store}/grid/session_date={day(0)}")}
    assert daily.clean_dates(after, store, day(2), day(2), step="1 hour") == (day(1), day(6))  # b has no tick before day 1 and after day 2 until day 6
    assert grid(spark, store, after) == grid(spark, whole, after)
    assert {f for f in os.listdir(f"{store}/grid/session_date={day(0)}")} == untouched


def test_dates_in_any_order_and_twice(spark, tmp_path):
    df = ticks(spark, ROWS + LATE)
    whole, store = str(tmp_path / "whole"), str(tmp_path / "store")
    daily.clean_dates(df, whole, day(0), day(6), step="6 hours")
    for k in (6, 2, 0, 3, 1, 5, 2, 4):
        daily.clean_dates(df, store, day(k), day(k), step="6 hours")
    assert grid(spark, store, df) == grid(spark, whole, df)


def test_a_date_that_loses_all_ticks_loses_its_partition(spark, tmp_path):
    """Earlier copies with bad prices arrive late and take the last date's ticks away, and with them the grid up to there."""
    rows = [("a", 0, 1.0, 5, 10.0, 3), ("a", 0, 2.0, 6, 10.0, 4), ("a", 2, 1.0, 7, 10.0, 3), ("a", 2, 2.0, 8, 10.0, 4)]
    bad = [("a", 2, 1.0, 1, -1.0, 3), ("a", 2, 2.0, 2, -1.0, 4)]
    store, whole = str(tmp_path / "store"), str(tmp_path / "whole")
    daily.clean_dates(ticks(spark, rows), store, day(0), day(2), step="1 hour")
    df = ticks(spark, rows + bad)
    daily.clean_dates(df, store, day(2), day(2), step="1 hour")
    daily.clean_dates(df, whole, day(0), day(2), step="1 hour")
    assert grid(spark, store, df) == grid(spark, whole, df)
    assert not os.path.exists(f"{store}/kept/session_date={day(2)}") and not os.path.exists(f"{store}/grid/session_date={day(2)}")


def test_dates_without_rows_and_bad_options(spark, tmp_path):
    df = ticks(spark, ROWS)
    assert daily.clean_dates(df, str(tmp_path / "s"), day(30), day(31), step="1 hour") == (day(30), day(31))
    assert grid(spark, str(tmp_path / "s"), df) == []
    with pytest.raises(ValueError, match="divide"):
        daily.clean_dates(df, str(tmp_path / "s"), day(0), day(1), step="7 hours")
    with pytest.raises(ValueError, match="after"):
        daily.clean_dates(df, str(tmp_path / "s"), day(1), day(0))


def test_only_the_dates_asked_for_are_read(spark, tmp_path):
    df = ticks(spark, ROWS)
    df.write.partitionBy("session_date").parquet(str(tmp_path / "raw"))
    raw = daily.stored(spark, str(tmp_path / "raw"), df.schema)
    plan = raw.where(F.col("session_date").between(F.lit(day(1)), F.lit(day(2))))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_date" in plan
