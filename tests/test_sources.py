from datetime import date

import pytest
from pyspark.sql import functions as F

from tickloom import sources
from tickloom.sources import schemas
from tickloom.plans import Axis


def test_feature_file_round_trip(spark, folder, tmp_path):
    ticks = sources.with_session_date(sources.market_table(spark, folder, "ticks"))
    path = sources.write_parquet(ticks, str(tmp_path / "f"), ("symbol", "session_date"), float32=True, spread_by=("symbol", "ts"))
    back = sources.read_parquet(spark, path).select(*ticks.columns)
    report = sources.verify(back, Axis(), sources.downcast_floats(ticks)).first()
    assert report.passed and report.missing == 0 and report.rows == ticks.count()
    assert dict(back.dtypes)["bid_price"] == "float"
    plan = back.filter("symbol = 'click' AND session_date = DATE '2024-01-05'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan


def test_stored_table_is_verified_from_its_footers(spark, folder, tmp_path):
    ticks = sources.with_session_date(sources.market_table(spark, folder, "ticks"))
    holes = ticks.withColumns({
        "bid_price": F.when(F.col("seq") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("bid_price")),
        "volume": F.when(F.col("seq") % 5 > 0, F.col("volume")), "symbol": F.when(F.col("seq") % 11 > 0, F.col("symbol")),
    })
    for by in ((), ("symbol",), ("symbol", "session_date")):
        path = sources.write_parquet(holes, str(tmp_path / f"f{len(by)}"), by)
        read = sources.verify(sources.read_parquet(spark, path).select(*holes.columns), Axis(), holes).first()
        assert sources.verify_stored(spark, path, Axis(), holes, by).first().asDict() == read.asDict()
        assert sources.verify_stored(spark, path, Axis(), holes, by, nan=True).first().missing == read.missing > 0
    raw = str(tmp_path / "raw")
    holes.write.parquet(raw)
    missing = lambda **o: sources.verify_stored(spark, raw, Axis(), **o).first().missing
    assert missing(nan=True) - missing() == holes.where("isnan(bid_price)").count() > 0


def test_footers_answer_counts_without_columns(spark, folder, tmp_path):
    ticks = sources.with_session_date(sources.market_table(spark, folder, "ticks"))
    path = sources.write_parquet(ticks, str(tmp_path / "f"), ("symbol", "session_date"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counts = plan(sources.footer_counts(sources.footers(spark, path), ("symbol", "session_date")))
    assert "PushedAggregation: [COUNT(*), COUNT(seq)" in counts
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_verify_stored_of_an_empty_table_and_another_schema(spark, folder, tmp_path):
    ticks = sources.market_table(spark, folder, "ticks")
    path = sources.write_parquet(ticks.where("false"), str(tmp_path / "e"))
    got = sources.verify_stored(spark, path, Axis(), ticks).first()
    assert (got.rows, got.first_ts, got.missing, got.passed) == (0, None, 0, False)
    assert sources.verify_stored(spark, path, Axis(), ticks.where("false")).first().passed
    assert not sources.verify_stored(spark, path, Axis(), ticks.where("false").drop("volume")).first().passed


def test_bars_are_read_by_range(spark, folder, tmp_path):
    bars = sources.market_table(spark, folder, "daily").select(
        "symbol", F.to_date("date").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume"
    )
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sources.write_csv(bars, path) if fmt == "csv" else sources.write_parquet(bars, path)
        got = sources.read_bars(spark, path, ["5-LOW"], date(1996, 1, 1), date(1997, 1, 1), fmt)
        want = bars.filter("symbol = '5-LOW' AND year(date) = 1996")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan


def test_minute_bars_drop_incomplete_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "k int, x double")
    df.write.parquet(str(tmp_path / "m"))
    assert sources.read_minute_bars(spark, str(tmp_path / "m")).count() == 1


def test_two_level_header_is_flattened(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Close_SPY double, Open_SPY double")
    assert sources.flatten_header(df).columns == ["Close", "Open"]


def test_conform_renames_casts_and_clears_nan(spark):
    df = spark.createDataFrame([("A", "2024-01-01 00:00:00", 1, float("nan"), 5.0)], "symbol string, timestamp string, seq int, trade_price double, trade_size double")
    out = sources.conform(df, schemas.TRADES, {"timestamp": "ts", "trade_price": "price", "trade_size": "volume"})
    assert [f.dataType for f in out.schema] == [f.dataType for f in schemas.TRADES]
    assert out.first().price is None and out.first().volume == 5
    with pytest.raises(ValueError, match="columns not found"):
        sources.conform(df, schemas.TRADES)


def test_date_slice_reaches_the_scan(spark, folder):
    from tickloom.operators import rows

    events = spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_id", "value")
    plan = rows.between_dates(events, "ts", date(2024, 1, 3), date(2024, 1, 5))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in plan and "LessThan(ts,2024-01-06T00:00)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan


def test_time_bars_combine_before_the_shuffle_without_a_sort(spark, folder):
    from tickloom.operators import bars

    ticks = sources.market_table(spark, folder, "trades")
    plan = bars.time_bars(ticks, Axis(), "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "HashAggregate" in plan
    assert "SortAggregate" not in plan and "Sort [" not in plan
