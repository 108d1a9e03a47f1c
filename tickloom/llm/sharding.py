"""K-d tree sharding by distributed weighted medians.

Every row is a point in metadata space (source, language, size, id), with its bytes as weight. A node of the tree that is to
hold k shards splits along its widest dimension, where its bytes divide as k // 2 to the rest. All nodes of a level
are split together: one aggregate finds their extents, and a few rounds of histograms over (node, bin) close in on the
weighted medians. Only the tree, one split per shard, is on the driver; a row finds its shard by joins with the splits of each
level, small tables that are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, utf8_size, whole, written

ROW_BYTES = 16
#: Bits of the splitting key settled by one histogram.
BIN_BITS = 16
KEY_BITS = 62
#: A split may be off by this part of a shard.
TOLERANCE = 1e-4
DIMENSIONS = ("source", "lang", "size", "doc_id")


@dataclass(frozen=True)
class Split:
    dimension: str
    #: Rows with a smaller key go left.
    at: int


def _code(values: Column) -> Column:
    """31 bits of a hash: texts without an order of their own."""
    return F.shiftrightunsigned(F.xxhash64(values), 33)


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> dict[str, Column]:
    """Columns of the metadata space, each of 31 bits, the tie-breaker ``_tie`` and the weight ``_size``."""
    size = utf8_size(F.col(text_col)) + ROW_BYTES
    log = F.floor(F.log2(size.cast("double")) * (1 << 25)).cast("long")
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))
    return {
        "_size": size, "_tie": F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 33),
        "_p_source": _code(F.col(source_col)), "_p_lang": _code(F.col(lang_col)), "_p_size": F.least(log, F.lit(2**31 - 1)), "_p_doc_id": F.least(F.greatest(ids, F.lit(0)), F.lit(2**62)),
    }


def _key(dimension: str, shift: int = 0) -> Column:
    value = F.col(f"_p_{dimension}")
    if shift:
        value = F.shiftright(value, shift)
    return F.shiftleft(value, 31).bitwiseOR(F.col("_tie"))


class KdTree:
    """Splits by node, a list for each level; the root is (0, n), a node (first shard, number of shards)."""

    def __init__(self, n_shards: int, id_shift: int):
        self.n_shards, self.id_shift, self.levels = n_shards, id_shift, []

    def key(self, dimension: Column) -> Column:
        """The splitting key along a dimension given by its number."""
        out = F.lit(None).cast("long")
        for i, d in enumerate(DIMENSIONS):
            out = F.when(dimension == i, _key(d, self.id_shift if d == "doc_id" else 0)).otherwise(out)
        return out

    def step(self, rows: DataFrame, splits: dict[int, tuple[Split, int]]) -> DataFrame:
        """``rows`` with the ``_node`` that they are in after the splits of one level, each with the shards to its left."""
        if not splits:
            return rows
        table = rows.sparkSession.createDataFrame([(n, DIMENSIONS.index(s.dimension), int(s.at), left) for n, (s, left) in splits.items()], "_of int, _dim int, _at long, _left int")
        joined = rows.join(F.broadcast(table), F.col("_node") == F.col("_of"), "left")
        right = F.when(self.key(F.col("_dim")) >= F.col("_at"), F.col("_left")).otherwise(0)
        return joined.withColumn("_node", F.col("_node") + right).drop("_of", "_dim", "_at", "_left")

    def leaves(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_node``, the first shard of the leaf that a row is in: one small table is joined for each level."""
        return reduce(self.step, self.levels, rows.withColumn("_node", F.lit(0)))


def _medians(rows: DataFrame, tree: KdTree, wanted: dict[int, tuple[str, int]], tolerance: float) -> dict[int, int]:
    """Splitting key of each node: ``wanted`` has its dimension and the bytes that are to lie below.

    The nodes still searched are a table that is joined, so a level may have any number of them.
    """
    low, below, found, bits = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), {}, KEY_BITS
    while len(found) < len(wanted):
        active = [(n, DIMENSIONS.index(wanted[n][0]), int(low[n]), int(wanted[n][1] - below[n])) for n in wanted if n not in found]
        table = rows.sparkSession.createDataFrame(active, "_of int, _dim int, _low long, _short long")
        step = min(BIN_BITS, bits)
        rest = bits - step
        keyed = rows.join(F.broadcast(table), F.col("_node") == F.col("_of")).withColumn("_above", tree.key(F.col("_dim")) - F.col("_low"))
        inside = keyed.where((F.col("_above") >= 0) & (F.col("_above") < F.lit(1 << bits)))
        bins = inside.groupBy("_node", F.shiftright("_above", rest).alias("_bin"), "_short").agg(F.sum("_size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("_node").orderBy("_bin"))
        crossing = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("_short")) & (F.col("upto") - F.col("bytes") < F.col("_short")))
        for r in crossing.collect():  # one row per node
            n, lower, upper = r["_node"], r["upto"] - r["bytes"], r["upto"]
            short = wanted[n][1] - below[n]
            if rest == 0 or min(short - lower, upper - short) <= tolerance:
                found[n] = low[n] + ((r["_bin"] + (upper - short <= short - lower)) << rest)
            else:
                low[n], below[n] = low[n] + (r["_bin"] << rest), below[n] + lower
        bits = rest
    return found


def build_tree(rows: DataFrame, n_shards: int) -> KdTree:
    """The tree over ``rows`` of ``points``; an empty table gives a tree without splits.

    The node of each row is written after every level, so no expression and no plan grows with the tree.
    """
    if n_shards < 1:
        raise ValueError("a tree has one shard at least")
    total, top = rows.agg(F.sum("_size"), F.max("_p_doc_id")).first()
    tree = KdTree(n_shards, max(0, int(top or 0).bit_length() - 31))
    if not total:
        return tree
    nodes, extent = {0: n_shards}, None
    node = rows.withColumn("_node", F.lit(0))
    while any(k > 1 for k in nodes.values()):
        marks = [f(F.col(f"_p_{d}")).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max))]
        facts = {r["_node"]: r for r in node.groupBy("_node").agg(F.sum("_size").alias("bytes"), *marks).collect()}  # a row per node
        width = lambda r, d: r[f"hi_{d}"] - r[f"lo_{d}"]
        extent = extent or {d: max(1, width(facts[0], d)) for d in DIMENSIONS}
        wanted = {}
        for n, k in nodes.items():
            if k > 1 and n in facts:
                widest = max(DIMENSIONS, key=lambda d: width(facts[n], d) / extent[d])
                wanted[n] = (widest, round(facts[n]["bytes"] * (k // 2) / k))
        at = _medians(node, tree, wanted, TOLERANCE * total / n_shards) if wanted else {}
        new, splits = {}, {}
        for n, k in nodes.items():
            if k > 1 and n in at:
                splits[n] = Split(wanted[n][0], at[n]), k // 2
                new[n], new[n + k // 2] = k // 2, k - k // 2
            else:
                new[n] = 1
        nodes = new
        tree.levels.append(splits)
        if any(k > 1 for k in nodes.values()):
            node = written(tree.step(node, splits), "nodes")
    return tree


def shards_for(docs: DataFrame, target_bytes: int, text_col: str = "text") -> int:
    total = docs.agg(F.sum(utf8_size(F.col(text_col)) + ROW_BYTES)).first()[0] or 0
    return max(1, round(total / target_bytes))


def with_shards(docs: DataFrame, n_shards: int, **columns: str) -> DataFrame:
    """``docs`` and its ``shard``, an int from 0; no row moves for it.

    Null texts weigh ``ROW_BYTES``; null sources, languages and ids are values like any other. Equal rows stay together, as nothing
    tells them apart; other ties are broken by a hash of id and text. A column named ``shard`` is replaced; others keep name and values.
    """
    space = points(docs, **columns)
    tree = build_tree(written(docs.select(*[c.alias(n) for n, c in space.items()]), "points"), n_shards)
    placed = tree.leaves(whole(docs, **space))
    return placed.select(*[F.col("row").getField(n).alias(n) for n in docs.columns if n != "shard"], F.col("_node").cast("int").alias("shard"))


def write_shards(docs: DataFrame, path: str, target_bytes: int, **columns: str) -> int:
    """Write ``docs`` as one folder per shard of about ``target_bytes``; returns how many."""
    n = shards_for(docs, target_bytes)
    with_shards(docs, n, **columns).write.partitionBy("shard").parquet(path)
    return n


def shard_slots(docs: DataFrame, n_shards: int, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, the gapless number of a row in its shard. A null text has a CRC of 0."""
    out = with_shards(docs, n_shards, **columns)
    text = F.col(columns.get("text_col", "text"))
    out = out.select(F.col(columns.get("id_col", "doc_id")).alias("doc_id"), (utf8_size(text) + ROW_BYTES).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), "shard")
    return numbered(written(out, "sharded"), "shard", ["doc_id", "text_crc32"], "slot")
