"""Helpers of the corpus operators: written intermediates, row numbers inside hot groups, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but the six ASCII spaces.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one of our own only on a single machine."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="tickloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, and a lost executor recomputes nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tickloom-llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_written(spark: SparkSession) -> None:
    """Delete what ``written`` has left; call it once the results that read it are stored."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def numbered(df: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """Add ``into``: gapless numbers from 0 inside each ``group``, in the order of a hash of ``order``.

    A group may hold any share of the rows: it is cut by hash into about sqrt(rows) pieces, pieces are numbered
    inside, and what the earlier pieces hold is added. No task sees a whole group. ``df`` is read twice.
    """
    n = max(1, math.isqrt(df.count()))
    h = F.xxhash64(*order)
    cut = df.withColumns({"_h": h, "_piece": F.pmod(h, F.lit(n))})
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, "_piece").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_piece").alias("_p"), "_before")
    inside = Window.partitionBy("_g", "_p").orderBy("_h", *order)
    return (
        cut.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p")))
        .withColumn(into, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_h", "_piece", "_g", "_p", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node id that each node of the undirected ``edges`` (a, b) is connected with.

    First every node keeps one edge, to its smallest neighbour below it (its hub), and its other neighbours below are linked
    with that hub: the same components, but a node that is nobody's hub has a single edge and takes no part in what
    follows. Among hubs, labels travel along edges and then jump to their label's label, so rounds grow with the logarithm
    of the longest chain. Every round is two joins and a minimum with partial aggregation, written to the shared
    folder; only the number of changed labels reaches the driver.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = written(down.groupBy("a").agg(F.min("b").alias("hub"), F.collect_set("b").alias("below")), "hub_of_node")
    links = written(down.select(F.explode("below").alias("a"), F.col("hub").alias("b")).distinct(), "hub_links")
    hubs = written(links.select(F.col("a").alias("hub_id")).distinct(), "hubs")
    is_hub = F.col("a") == F.col("hub_id")
    above = down.select("a", F.col("hub").alias("b")).join(hubs, is_hub, "left_semi")
    label = _spread(hubs.select(F.col("hub_id").alias("node")), links.where("a <> b").unionByName(above))
    of_hub = label.select(F.col("node").alias("hub"), "label")
    leaves = down.select("a", "hub").join(hubs, is_hub, "left_anti").join(of_hub, "hub").select(F.col("a").alias("node"), "label")
    return label.unionByName(leaves)


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of ``nodes``, all ends of the ``edges`` (a, b) among them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = written(nodes.join(low, "node", "left").select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("mid"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = written(step.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def whole(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """``row``, all columns of ``docs`` as one struct, and the ``columns`` of an operator, whose names then clash with none of a user's.

    ``select("row.*")`` gives the user's columns back as they were.
    """
    return docs.select(F.struct("*").alias("row"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
