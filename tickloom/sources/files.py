"""CSV and Parquet readers and writers, the float32 downcast, and the read-back check."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null
from ..plans import Axis, TICKS
from .schemas import DAILY_BARS


def read_csv(spark: SparkSession, path, schema: T.StructType | str, date_format: str | None = None) -> DataFrame:
    """CSV with a header and a declared schema; ``date_format`` parses its date column."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if date_format:
        reader = reader.option("dateFormat", date_format)
    return nan_to_null(reader.schema(schema).csv(path))


def read_parquet(spark: SparkSession, *paths: str, where: str | Column | None = None) -> DataFrame:
    """Parquet with NaN as NULL. ``where`` is applied to the stored columns first, so that the scan can skip by it.

    A comparison with a NaN column counts NaN as larger than any number; such rows are taken out again afterwards by the
    same condition, where NULL meets none.
    """
    df = spark.read.parquet(*paths)
    if where is None:
        return nan_to_null(df)
    return nan_to_null(df.filter(where)).filter(where)


def read_bars(
    spark: SparkSession, path: str, symbols: list[str] | None = None, first: date | None = None,
    last: date | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Landed daily bars of some symbols from ``first`` up to but not including ``last``."""
    df = read_csv(spark, path, DAILY_BARS) if fmt == "csv" else nan_to_null(spark.read.schema(DAILY_BARS).parquet(path))
    if symbols:
        df = df.filter(F.col("symbol").isin(*symbols))
    if first:
        df = df.filter(F.col("date") >= F.lit(first))
    return df.filter(F.col("date") < F.lit(last)) if last else df


def read_minute_bars(spark: SparkSession, path: str) -> DataFrame:
    """Intraday bars with every incomplete row dropped."""
    return read_parquet(spark, path).na.drop("any")


def flatten_header(df: DataFrame, sep: str = "_") -> DataFrame:
    """Keep the first level of two-level column names such as ``Close_SPY``."""
    return df.toDF(*[c.split(sep)[0] for c in df.columns])


def downcast_floats(df: DataFrame) -> DataFrame:
    """Store doubles as floats."""
    return df.select(
        *[F.col(f.name).cast("float").alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), float32: bool = False, mode: str = "errorifexists",
    spread_by: tuple[str, ...] = (), files: int | None = None,
) -> str:
    """Snappy Parquet, optionally partitioned by columns such as symbol and session date.

    ``spread_by`` range-partitions the rows first, so each output folder is written by few
    tasks and a large one by several. NaN is stored as NULL, so that null counts in the footers are those of ``read_parquet``.
    """
    out = nan_to_null(downcast_floats(df) if float32 else df)
    if spread_by:
        out = out.repartitionByRange(*([files] if files else []), *spread_by)
    writer = out.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def with_session_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the calendar date of the event, for partitioning and session resets."""
    return df.withColumn("session_date", F.to_date(ts))


def verify(df: DataFrame, axis: Axis = TICKS, expected: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, first and last time, missing values, schema, and whether the
    row count and the schema equal ``expected``'s."""
    ts = axis.ts
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    report = df.agg(
        F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), missing.alias("missing")
    ).withColumns({"columns": F.lit(len(df.columns)), "schema": F.lit(schema)})
    if expected is None:
        return report
    same = schema == ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in expected.schema)
    counted = expected.agg(F.count("*"))
    return report.withColumn("expected_rows", counted.scalar()).withColumn(
        "passed", (F.col("rows") == F.col("expected_rows")) & F.lit(same)
    )


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` in a session of its own, where counts and extremes without a filter are answered by Parquet footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own.read.parquet(path)


def footer_counts(table: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` and ``missing`` (NULLs of stored columns) for each partition of ``footers``' table; no column is read."""
    stored = [c for c in table.columns if c not in partition_by]
    counts = table.groupBy(*partition_by).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(stored)])
    known = sum((F.col(f"_n{i}") for i in range(len(stored))), F.lit(0))
    return counts.select(*partition_by, "rows", (len(stored) * F.col("rows") - known).alias("missing"))


def verify_stored(
    spark: SparkSession, path: str, axis: Axis = TICKS, expected: DataFrame | None = None,
    partition_by: tuple[str, ...] = (), date_col: str = "session_date", nan: bool = False,
) -> DataFrame:
    """``verify`` of a stored table without reading it again.

    Rows and missing values come from the footers. Footers do not tell extremes of times, so the time column is read, but
    of the first and the last date only if ``date_col`` is one of ``partition_by`` (and rows without a date are none).
    ``nan`` also reads the floating columns and counts their NaN as missing, for files that ``write_parquet`` did not write.
    """
    table = footers(spark, path)
    absent = sum((F.when(F.col(c).isNull(), F.col("rows")).otherwise(0) for c in partition_by), F.lit(0))
    by_date = date_col in partition_by
    dates = [F.min(date_col), F.max(date_col), F.count_if(F.col(date_col).isNull())] if by_date else []
    sums = [F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.col("missing") + absent), F.lit(0))]
    rows, missing, *edge = footer_counts(table, partition_by).agg(*sums, *dates).first()
    times = table.where(F.col(date_col).isin(*edge[:2])) if by_date and rows and not edge[2] else table
    first_ts, last_ts = times.agg(F.min(axis.ts), F.max(axis.ts)).first()
    floats = [f.name for f in table.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if nan and floats:
        missing += table.agg(sum((F.count_if(F.isnan(c)) for c in floats), F.lit(0))).first()[0]
    typed = {f.name: f.dataType.simpleString() for f in table.schema}
    order = expected.columns if expected is not None and set(expected.columns) == set(typed) else table.columns
    found = ",".join(f"{c}:{typed[c]}" for c in order)
    time = table.schema[axis.ts].dataType.simpleString()
    report = spark.createDataFrame(
        [(rows, first_ts, last_ts, missing, len(typed), found)],
        f"rows bigint, first_ts {time}, last_ts {time}, missing bigint, columns int, schema string",
    )
    if expected is None:
        return report
    same = found == ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in expected.schema)
    return report.withColumn("expected_rows", expected.agg(F.count("*")).scalar()).withColumn("passed", (F.col("rows") == F.col("expected_rows")) & F.lit(same))
