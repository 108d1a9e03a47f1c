"""Mixing sources to target weights by Pfair scheduling.

A source with weight w owns block k in the slots from its release, floor(k / w), to its deadline, ceil((k + 1) / w).
Earliest deadline first among the released blocks keeps every source within less than one block of w times the slots so far.
Weights are whole shares over their sum, so releases and deadlines are exact, and there may be any number of sources.

The schedule is worked out by halving the deadlines, not slot by slot. Whatever the order among them, the blocks of the
earlier half take exactly the slots in which one of them waits: a queue, which running sums and a running minimum tell for all slots
at once. The later half shares the slots that are left, and both halves go on alone. After as many rounds as a slot number has
bits, each deadline has its slots, and its blocks take them by release. Every round is one exchange of blocks and slots by
node and stretch of time; stretches are joined by the few numbers that each leaves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, whole, written

BLOCK_ROWS = 32
#: Target weight: the source's share of blocks to this power, which raises small sources a little.
TEMPERATURE = 0.9
#: Shares of the target weights add up to about this.
RESOLUTION = 1 << 30
#: Bits of the slots that one window holds; blocks of one array.
STRETCH_BITS = 16
ARRAY = 1 << 14


def tempered_shares(docs: DataFrame, source_col: str = "source", block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE, resolution: int = RESOLUTION) -> DataFrame:
    """(source, share): whole shares of about ``resolution``, as a source's number of blocks to the power ``temperature``.

    Rows without a source count as one more source, null.
    """
    size = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.pow(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(temperature)).alias("w"))
    total = size.agg(F.sum("w")).first()[0] or 1.0
    return size.select("source", F.greatest(F.lit(1), F.round(F.col("w") * (resolution / total))).cast("long").alias("share"))


def _turns(sources: DataFrame, total: int, slots: int) -> DataFrame:
    """(key, k, release, deadline) of all blocks released before ``slots``."""
    n = F.expr(f"({slots}L * share + {total - 1}L) div {total}L")
    parts = sources.withColumn("n", n).select("key", "share", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {ARRAY}L"))).alias("part"))
    # a hot source's parts are dealt out before they become rows
    parts = parts.repartition("key", "part")
    each = parts.select("key", "share", F.explode(F.sequence(F.col("part") * ARRAY, F.least("n", (F.col("part") + 1) * ARRAY) - 1)).alias("k"))
    return each.select("key", "k", F.expr(f"(k * {total}L) div share").alias("release"), F.expr(f"((k + 1) * {total}L + share - 1) div share").alias("deadline"))


def _halved(events: DataFrame, bit: int, slots: int) -> DataFrame:
    """Blocks and slots of each node dealt to its two halves by the next bit of the deadlines."""
    later = F.expr(f"shiftright(due, {bit}) & 1")
    step = F.when(F.col("is_slot"), -1).when(later == 0, 1).otherwise(0)
    # blocks released at a slot's time come before it
    inside = Window.partitionBy("node", "stretch").orderBy("time", "is_slot")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    queue = events.withColumn("stretch", F.shiftright("time", STRETCH_BITS)).withColumn("sum", F.sum(step).over(upto)).withColumn("low", F.min("sum").over(before))
    if slots > 1 << STRETCH_BITS:
        left = queue.groupBy("node", "stretch").agg(F.sum(step).alias("total"), F.min("sum").alias("least"))
        earlier = Window.partitionBy("node").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        left = left.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        left = left.withColumn("floor", F.min(F.col("base") + F.col("least")).over(earlier)).select("node", "stretch", "base", "floor")
        queue = queue.join(left, ["node", "stretch"]).withColumns({"sum": F.col("sum") + F.col("base"), "low": F.least(F.col("low") + F.col("base"), "floor")})
    # a slot in which nothing waits takes the sum to a new minimum
    waited = F.col("sum") >= F.least(F.lit(0), F.coalesce("low", F.lit(0)))
    half = F.when(F.col("is_slot"), F.when(waited, 0).otherwise(1)).otherwise(later)
    return queue.select((F.col("node") * 2 + half).alias("node"), "time", "is_slot", "key", "k", "due")


def edf_schedule(sources: DataFrame, total: int, slots: int) -> DataFrame:
    """(key, k, release, deadline, slot): earliest deadline first over ``slots`` slots.

    ``sources`` (key, share) have whole positive shares that sum to ``total``. Blocks of one deadline go by release, then
    by key; deadlines after the last slot count as one. ``slots * total`` must stay below 2^63.
    """
    turns = written(_turns(sources, total, slots), "turns")
    due = F.least("deadline", F.lit(slots + 1))
    zero = F.lit(0).cast("long")
    blocks = turns.select(zero.alias("node"), F.col("release").alias("time"), F.lit(False).alias("is_slot"), "key", "k", due.alias("due"))
    every = sources.sparkSession.range(slots).select(zero.alias("node"), F.col("id").alias("time"), F.lit(True).alias("is_slot"), F.lit(None).cast("string").alias("key"), zero.alias("k"), zero.alias("due"))
    events = blocks.unionByName(every)
    for bit in reversed(range((slots + 1).bit_length())):
        events = written(_halved(events, bit, slots), "halves")
    order = Window.partitionBy("node").orderBy("time", "key", "k")
    number = F.row_number().over(order).alias("number")
    placed = events.where("NOT is_slot").select("node", "key", "k", number)
    free = events.where("is_slot").select("node", F.col("time").alias("slot"), number)
    return placed.join(free, ["node", "number"]).select("key", "k", "slot").join(turns, ["key", "k"])


def mixed_rows(docs: DataFrame, shares: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and source, block, epoch, release, deadline, slot: see ``mix``."""
    if shares is None:
        shares = tempered_shares(docs, source_col, block_rows)
    # a key that is never null, so that joins are plain
    key = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    source = F.col(source_col).cast("string")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    named = whole(docs, key=key(source), id=id_col if id_col in docs.columns else F.lit(None), row_hash=F.xxhash64(*plain))
    shares = shares.select(key(F.col("source").cast("string")).alias("key"), F.col("source").cast("string").alias("source"), F.col("share").cast("long").alias("share"))
    sizes = named.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("blocks"))
    sources = sizes.join(shares, "key", "left")
    known = F.coalesce(F.assert_true(F.col("share") > 0, F.lit("a source has no share")).cast("int"), F.lit(0)) == 0
    sources = written(sources.where(known), "sources")
    total = sources.agg(F.sum("share")).first()[0] or 1
    slots = sources.agg(F.max(F.expr(f"(blocks * {total}L + share - 1) div share"))).first()[0] or 0
    schedule = edf_schedule(sources.select("key", "share"), total, slots).join(sources.select("key", "source", "blocks"), "key")
    schedule = schedule.select("key", F.expr("k % blocks").alias("block"), F.expr("k div blocks").alias("epoch"), "source", "release", "deadline", "slot")
    placed = numbered(named, "key", ["id", "row_hash"], "place").withColumn("block", F.expr(f"place div {block_rows}L"))
    return placed.select("row", "key", "block").join(written(schedule, "schedule"), ["key", "block"]).select("row", "source", "block", "epoch", "release", "deadline", "slot")


def mix(docs: DataFrame, shares: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``docs`` and _source, _block, _epoch, _release, _deadline, _slot.

    ``shares`` (source, share) are whole numbers; a source's weight is its share of the shares of all sources of ``docs``.
    The mix lasts until every source has been used whole; a source that ends earlier starts again (``_epoch`` 1, 2, ...), so
    nothing is dropped and weights hold to the end. A source of ``docs`` without a share is refused. Repeated rows
    are rows of their own. An empty table gives no rows. Columns of ``docs`` that have one of the six names are replaced.
    """
    added = ("source", "block", "epoch", "release", "deadline", "slot")
    rows = mixed_rows(docs, shares, id_col, source_col, block_rows)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in {f"_{a}" for a in added}]
    return rows.select(*kept, *[F.col(a).alias(f"_{a}") for a in added])


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mix, with its own columns only, whatever their names."""
    return mixed_rows(docs, **options).repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")
