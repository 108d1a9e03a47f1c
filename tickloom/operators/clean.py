"""Tick cleaning: duplicates, bad prices, gaps, bad volume, regular grid, UTC, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import from_micros, interval_micros, micros
from ..plans import Axis, TICKS, after, attach, before, over_rows, running
from ..plans.axis import GROWN

#: Longest run of grid points made from one array; a longer gap is split into several.
GRID_SEGMENT = 86_400


def first_arrivals(df: DataFrame, axis: Axis = TICKS, copies: str | None = None) -> DataFrame:
    """One row per key and time stamp: the one that arrived first.

    ``min_by`` combines before the shuffle, so a time stamp with very many copies costs one
    row per task, not a sort of all of them.
    """
    on = [*axis.keys, axis.ts]
    arrival = axis.order[1]
    rest = [c for c in df.columns if c not in on]
    counted = [F.count("*").alias(copies)] if copies else []
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if not any(isinstance(df.schema[c].dataType, wide) for c in rest):
        # column by column, a hash table can hold the state; a struct would make Spark sort all rows twice
        aggs = [F.min(c).alias(c) if c == arrival else F.min_by(c, F.col(arrival)).alias(c) for c in rest]
        return df.groupBy(*on).agg(*aggs, *counted).select(*df.columns, *([copies] if copies else []))
    kept = df.groupBy(*on).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("_row"), *counted)
    return kept.select(*on, "_row.*", *([copies] if copies else [])).select(*df.columns, *([copies] if copies else []))


def regular_grid(df: DataFrame, axis: Axis = TICKS, step: str = "1 second") -> DataFrame:
    """Last known row at every point of a regular grid, for each key.

    The grid runs from the step holding the first tick to the step holding the last one. A
    grid point before the first tick has missing values. Each tick emits the grid points up
    to its successor, so there is no join and no ordered single task.
    """
    axis = axis.measured(df)
    us = interval_micros(step)
    ts = axis.ts
    values = [c for c in df.columns if c not in (*axis.keys, ts)]

    def neighbours(d, w):
        return d.withColumns({"_next": after(ts, w), "_prev": before(ts, w)})

    here, upto = micros(ts), F.coalesce(micros("_next") - 1, micros(ts))
    down, up = here - F.pmod(here, us), here + F.pmod(-here, us)
    first_point = F.when(F.col("_prev").isNull(), down).otherwise(up)
    last_point = upto - F.pmod(upto, us)
    spans = (
        over_rows(df, axis, neighbours, back=1, ahead=1)
        .withColumns({"_from": first_point, "_to": last_point})
        .filter("_from <= _to")
        .withColumn("_part", F.explode(F.expr(f"sequence(_from, _to, {us * GRID_SEGMENT}L)")))
        .withColumn(
            "_point",
            F.explode(F.expr(f"sequence(_part, least(_part + {us * (GRID_SEGMENT - 1)}L, _to), {us}L)")),
        )
    )
    known = F.col("_point") >= here
    return spans.select(
        *axis.keys,
        from_micros(F.col("_point")).alias(ts, metadata={GROWN: step}),
        *[F.when(known, F.col(c)).alias(c) for c in values],
    )


def to_utc(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Declare a zone-less wall clock to be UTC; a column that has a zone already is refused."""
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        raise TypeError(f"{ts} is already zone-aware")
    return df.withColumn(ts, F.col(ts).cast("timestamp").alias(ts, metadata=df.schema[ts].metadata))


def flag_ticks(
    df: DataFrame, axis: Axis, gap_policy: str = "drop", volume_sigmas: float = 5.0, price: str = "price", volume: str = "volume",
) -> DataFrame:
    """First arrivals with ``_copies``, ``_good`` (price), ``_gap`` (no price) and ``_fair`` (good, and volume above zero and below its key's cap)."""
    unique = first_arrivals(df, axis, copies="_copies")
    good = F.coalesce(F.col(price) > 0, F.lit(gap_policy == "ffill"))
    flagged = unique.withColumns({"_good": good, "_gap": F.col(price).isNull()})
    limits = flagged.filter("_good").groupBy(*axis.keys).agg(
        (F.avg(volume) + volume_sigmas * F.stddev_samp(volume)).alias("_cap")
    )
    fair = F.coalesce((F.col(volume) > 0) & (F.col(volume) < F.col("_cap")), F.lit(False))
    return attach(flagged, limits, axis.keys, axis.n_keys).withColumn("_fair", F.col("_good") & fair)


def clean_ticks(
    df: DataFrame,
    axis: Axis = TICKS,
    step: str = "1 second",
    gap_policy: str = "drop",
    volume_sigmas: float = 5.0,
    price: str = "price",
    volume: str = "volume",
    utc: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning run, and a one-row-per-key audit of what each step removed.

    Steps in order: duplicates of a time stamp, non-positive prices, gaps, zero and extreme
    volume, regular grid, UTC. With ``gap_policy='drop'`` a missing price leaves with the bad
    ones, so nothing is left to fill; ``'ffill'`` keeps those rows and fills them forward.
    """
    if gap_policy not in ("drop", "ffill"):
        raise ValueError("gap_policy must be 'drop' or 'ffill'")
    axis = axis.measured(df)
    flagged = flag_ticks(df, axis, gap_policy, volume_sigmas, price, volume)
    us = interval_micros(step)

    def step_number(edge):
        return F.floor(micros(edge) / us)

    audit = (
        flagged.groupBy(*axis.keys)
        .agg(
            F.sum("_copies").alias("rows_in"),
            F.sum(F.col("_copies") - 1).alias("duplicates_removed"),
            F.count_if(~F.col("_good")).alias("bad_prices_removed"),
            F.count_if(F.col("_good") & F.col("_gap")).alias("prices_ffilled"),
            F.count_if(F.col("_good") & ~F.col("_fair")).alias("bad_volume_removed"),
            F.min(F.when(F.col("_fair"), F.col(axis.ts))).alias("_first"),
            F.max(F.when(F.col("_fair"), F.col(axis.ts))).alias("_last"),
        )
        .withColumn("rows_out", F.coalesce(step_number("_last") - step_number("_first") + 1, F.lit(0)))
        .drop("_first", "_last")
    )

    kept = flagged.filter("_good")
    if gap_policy == "ffill":
        kept = running(kept, axis, _filled=("last", price)).withColumn(price, F.col("_filled")).drop("_filled")
    kept = kept.filter("_fair").drop("_copies", "_good", "_gap", "_cap", "_fair")
    grid = regular_grid(kept, axis, step)
    return (to_utc(grid, axis.ts) if utc else grid), audit
