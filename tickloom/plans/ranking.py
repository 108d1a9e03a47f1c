"""Tie-averaged ranks and exact quantiles per key, without sorting a large key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .axis import POS, Axis
from .layout import attach, materialise, number_rows
from .running import running


def value_counts_upto(df: DataFrame, axis: Axis, x: str) -> DataFrame:
    """One row per distinct value of ``x`` in a key: its count and the count of values up to it."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*axis.keys, x).agg(F.count("*").alias("_same"))
    return running(counts, axis.ordered_by(x), _upto=("sum", "_same"))


def _ranked_in_cuts(df: DataFrame, axis: Axis, x: str, name: str) -> DataFrame:
    """One range sort by value numbers the known rows of each key, and equal cuts of the numbers are ranked on their own.

    A row's rank is half-way between the first and the last number of its ties. Only the first and the last value of a
    cut can have ties in other cuts; where those begin and end comes from a table with one row for each cut. Ties are
    numbered by the axis' own order, as far as ``df`` has it, so a value with very many rows is sorted in as many pieces
    as it needs.
    """
    places = [c for c in axis.order if c != x and c in df.columns]
    known = number_rows(df.filter(F.col(x).isNotNull()), axis.ordered_by(x, *places))
    cut, size = [*axis.keys, "_cut"], axis.rows_per_task
    known = known.withColumn("_cut", F.expr(f"{POS} div {size}L"))
    by_value = W.partitionBy(*cut).orderBy(x)
    # the ordered frame ends after the last tie
    ties = {"_first": F.col("_cut") * size + F.rank().over(by_value) - 1, "_last": F.col("_cut") * size + F.count(x).over(by_value) - 1}
    edges = materialise(
        known.select(*cut, x).withColumns(ties).groupBy(*cut)
        .agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.min("_first").alias("_a"), F.min("_last").alias("_b"), F.max("_first").alias("_c"), F.max("_last").alias("_d"))
    )
    ends = lambda value, first, last: edges.select(*axis.keys, F.col(value).alias("_v"), F.col(first).alias("_f"), F.col(last).alias("_l"))
    spans = ends("_low", "_a", "_b").unionByName(ends("_high", "_c", "_d")).groupBy(*axis.keys, "_v").agg(F.min("_f").alias("_f"), F.max("_l").alias("_l"))
    low, high = (spans.select(*axis.keys, F.col("_v").alias(f"_{s}"), F.col("_f").alias(f"_{s}_f"), F.col("_l").alias(f"_{s}_l")) for s in ("low", "high"))
    edges = edges.select(*cut, "_low", "_high").join(low, [*axis.keys, "_low"]).join(high, [*axis.keys, "_high"])
    rows = axis.total if axis.total is not None else axis.widest * (axis.n_keys or 1)
    placed = attach(known.withColumns(ties), edges, tuple(cut), rows // size + (axis.n_keys or rows))
    at = lambda side, own: F.when(F.col(x) == F.col("_low"), F.col(f"_low_{side}")).when(F.col(x) == F.col("_high"), F.col(f"_high_{side}")).otherwise(F.col(own))
    ranked = placed.withColumn(name, (at("f", "_first") + at("l", "_last")) / 2 + 1).select(*df.columns, name)
    return ranked.unionByName(df.filter(F.col(x).isNull()).withColumn(name, F.lit(None).cast("double")))


def average_rank(df: DataFrame, axis: Axis, **ranks: str) -> DataFrame:
    """Add ``name = column`` ranks: 1-based, ties averaged, among the known values of a key."""
    axis = axis.measured(df)
    if not axis.fits:
        df = materialise(df)  # each rank below reads its input more than once
        for name, x in ranks.items():
            df = _ranked_in_cuts(df, axis, x, name)
        return df
    added = {}
    for name, x in ranks.items():
        w = W.partitionBy(*axis.keys).orderBy(F.col(x).asc_nulls_last())
        # the ordered frame ends after the last tie, so the count is the number of values <= x
        added[name] = F.when(F.col(x).isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2)
    return df.withColumns(added)


#: Rank error of the sketch that brackets a quantile, as one part in so many; finer for keys whose brackets would not fit in a task.
SKETCH_PARTS = 2_000


def _sketch_parts(axis: Axis) -> int:
    return max(SKETCH_PARTS, -(-8 * (axis.widest or 0) // axis.rows_per_task))


def _bracketed(df: DataFrame, axis: Axis, x: str, probs: list[float]) -> DataFrame:
    """(keys, i, value, count, upto): the distinct values in the bracket of the i-th quantile, and how many are not above.

    A sketch per key, merged across tasks, names two values between which each quantile must lie. One pass over the rows
    then counts what is below each bracket and keeps what is inside, equal values as one; only that is shuffled. A bracket
    reaches twice the sketch's error to both sides, so keys need more than twice as many values as the sketch has parts.
    """
    parts = _sketch_parts(axis)
    ends = [min(1.0, max(0.0, p + side * 2 / parts)) for p in probs for side in (-1, 1)]
    known = df.filter(F.col(x).isNotNull()).select(*axis.keys, F.col(x).alias("_x"))
    cuts = known.groupBy(*axis.keys).agg(F.percentile_approx("_x", ends, parts).alias("_cuts"))
    near = F.array(
        *[
            F.when(F.col("_x") <= F.get("_cuts", F.lit(2 * i + 1)), F.struct(F.lit(i).alias("_i"), F.when(F.col("_x") >= F.get("_cuts", F.lit(2 * i)), F.col("_x")).alias("_v")))
            for i in range(len(probs))
        ]
    )
    met = attach(known, cuts, axis.keys, axis.n_keys).select(*axis.keys, F.explode(F.array_compact(near)).alias("_m")).select(*axis.keys, "_m.*")
    counts = met.groupBy(*axis.keys, "_i", "_v").agg(F.count("*").alias("_same"))
    upto = W.partitionBy(*axis.keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_same").over(upto)).filter(F.col("_v").isNotNull())


def quantiles(df: DataFrame, axis: Axis, x: str, probs: list[float], name: str = "q") -> DataFrame:
    """Exact, linearly interpolated quantiles of ``x`` per key as an array column; null for a key without known values."""
    axis = axis.measured(df)
    if axis.fits:
        return df.groupBy(*axis.keys).agg(F.percentile(x, F.array(*map(F.lit, probs))).alias(name))
    sizes = df.groupBy(*axis.keys).agg(F.count(x).alias("_n"))
    few = F.col("_n") <= 2 * _sketch_parts(axis)
    # a key with so few values is a small group; for the others the sketch's bound is worth more than a rank
    met = attach(df.select(*axis.keys, x), sizes, axis.keys, axis.n_keys)
    small = met.filter(few).groupBy(*axis.keys).agg(F.percentile(x, F.array(*map(F.lit, probs))).alias(name))
    placed = attach(sizes.filter(~few), _bracketed(met.filter(~few), axis, x, probs), axis.keys, None)

    def value_at(i, index):
        holds = (F.col("_i") == i) & (F.col("_upto") - F.col("_same") <= index) & (index < F.col("_upto"))
        return F.max(F.when(holds, F.col("_v")))

    spots = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ends = []
    for i, spot in enumerate(spots):
        ends += [value_at(i, F.floor(spot)).alias(f"_lo{i}"), value_at(i, F.ceil(spot)).alias(f"_hi{i}")]
    found = placed.groupBy(*axis.keys).agg(F.max("_n").alias("_n"), *ends)
    # a bracket that missed its quantile would break the sketch's bound; the job stops rather than answer
    held = F.greatest(*[F.col(c).isNull().cast("int") for i in range(len(probs)) for c in (f"_lo{i}", f"_hi{i}")], F.lit(0))
    checked = F.coalesce(F.assert_true(held == 0, F.lit("a quantile lies outside its bracket")).cast("int"), F.lit(0)) == 0
    lies = lambda i, spot: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot))
    return small.unionByName(found.filter(checked).select(*axis.keys, F.array(*[lies(i, spot) for i, spot in enumerate(spots)]).alias(name)))
