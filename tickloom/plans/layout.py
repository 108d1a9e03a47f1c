"""Row numbering and materialising for keys that are too large for one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .axis import POS, Axis

#: Largest table, in rows, that is broadcast. Beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows that one task of a range sort may take; more of them spill but still run.
ROWS_PER_PIECE = 20_000_000

_written: list[str] = []


def shared_folder(spark) -> str:
    """The folder for cut lineage: the cluster's own setting, or a scratch one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes then see one fixed set of rows, whatever executors are lost, and read only
    the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_materialised(spark) -> int:
    """Delete the tables this process wrote with ``materialise``, once their results are no longer read."""
    count = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def attach(df: DataFrame, small: DataFrame, on: tuple[str, ...], rows: int | None) -> DataFrame:
    """Left join per-group values back onto rows, keeping rows with a missing key.

    ``rows`` is a known bound on the size of ``small``. Within ``BROADCAST_ROWS`` it is
    broadcast and ``df`` does not move; otherwise it is a plain equi-join, which adaptive
    execution splits where a key is skewed.
    """
    renamed = small.withColumnsRenamed({k: f"_on_{k}" for k in on})
    if rows is not None and rows <= BROADCAST_ROWS:
        renamed = F.broadcast(renamed)
    same = [df[k].eqNullSafe(renamed[f"_on_{k}"]) for k in on]
    return df.join(renamed, same, "left").drop(*[f"_on_{k}" for k in on])


def number_rows(df: DataFrame, axis: Axis) -> DataFrame:
    """Add ``_pos``, the 0-based row number of each row inside its key.

    A window would put a whole key into one task. Here the rows are range-partitioned on
    (key, order), so a large key spreads over as many partitions as its rows need; the few
    (partition, key) counts give each piece its starting number.
    """
    axis = axis.measured(df)
    spark = df.sparkSession
    rows = axis.total if axis.total is not None else axis.widest
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PIECE))
    columns = [*axis.keys, *axis.order]
    sorted_rows = (
        df.repartitionByRange(pieces, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tape = materialise(sorted_rows).withColumn("_piece", F.shiftright("_mid", 33))
    on = (*axis.keys, "_piece")
    earlier = W.partitionBy(*axis.keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        tape.groupBy(*on)
        .agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    bound = None if axis.n_keys is None else pieces + axis.n_keys
    return (
        attach(tape, starts, on, rows=bound)
        .withColumn(POS, F.col("_mid") - F.col("_first") + F.col("_before"))
        .drop("_mid", "_piece", "_first", "_before")
    )


def lay_out(df: DataFrame, axis: Axis) -> DataFrame:
    """Number the rows once, ahead of several ordered steps, if any key is too large.

    Pass ``laid_out=True`` to those steps. It holds only until rows are filtered: numbers with holes would cut
    runs and their edges in the wrong places, so steps without the flag number the rows again.
    """
    axis = axis.measured(df)
    return df.drop(POS) if axis.fits else number_rows(df.drop(POS), axis)


def with_positions(df: DataFrame, axis: Axis) -> DataFrame:
    """Add ``_pos`` by whichever way the measured key sizes allow."""
    axis = axis.measured(df)
    df = df.drop(POS)
    if axis.fits:
        return df.withColumn(POS, (F.row_number().over(axis.window()) - 1).cast("bigint"))
    return number_rows(df, axis)
