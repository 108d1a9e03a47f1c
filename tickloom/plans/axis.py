"""The ordering axis of a keyed event table.

Rows in Spark have no position, so every ordered operator takes an ``Axis``: the columns
that name one series (``keys``) and the columns that order the rows inside it (``order``,
which must be a total order, normally event time followed by an arrival number).

An axis can also carry what is known about the size of the data: the row count of its
largest key (``widest``), the number of keys (``n_keys``) and of rows (``total``).  ``measured``
fills them with one small aggregate; frames derived by filtering or aggregating have no more rows per key,
so the same measured axis stays a valid upper bound for them and is passed along. For what is derived from a
regular grid, pass ``axis.measured(grid)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"


def ordered_window(parts: tuple[str, ...] | list[str], order: tuple[str, ...] | list[str]) -> WindowSpec:
    """A window that remembers its columns in ``parts`` and ``order``, for steps that cut its rows further."""
    w = W.partitionBy(*parts).orderBy(*order)
    w.parts, w.order = tuple(parts), tuple(order)
    return w


#: Column metadata under which an operator that adds rows marks the time column of its result.
GROWN = "tickloom.grown"


@dataclass(frozen=True)
class Axis:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts", "seq")
    rows_per_task: int = 500_000
    widest: int | None = None
    n_keys: int | None = None
    total: int | None = None
    #: Mark of the table the bounds were measured on, if that one was made by adding rows.
    grown: str | None = None

    def __post_init__(self):
        if not self.keys:
            raise ValueError("an axis needs at least one key column")
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "order", tuple(self.order))

    @property
    def ts(self) -> str:
        return self.order[0]

    @property
    def fits(self) -> bool:
        """True when every key is known to fit in one task."""
        return self.widest is not None and self.widest <= self.rows_per_task

    def measured(self, df: DataFrame) -> "Axis":
        """Return the axis with the size bounds of ``df``; a no-op when they are known.

        A table that an operator has filled with new rows (a regular grid) is marked; bounds that were taken before are
        not believed for it and are measured again.
        """
        mark = df.schema[self.ts].metadata.get(GROWN) if self.ts in df.columns else None
        if self.widest is not None and mark in (None, self.grown):
            return self
        row = (
            df.groupBy(*self.keys).count()
            .agg(F.max("count").alias("widest"), F.count("*").alias("n_keys"), F.sum("count").alias("total"))
            .first()
        )
        return replace(self, widest=row["widest"] or 0, n_keys=row["n_keys"], total=row["total"] or 0, grown=mark)

    def unmeasured(self) -> "Axis":
        """Forget the bounds, for a frame that may hold more rows than the measured one."""
        return replace(self, widest=None, n_keys=None, total=None, grown=None)

    def by(self, *extra: str, groups: int | None = None) -> "Axis":
        """A finer axis: the same bounds hold, with up to ``groups`` values per key."""
        known = self.n_keys is not None and groups
        return replace(
            self, keys=self.keys + extra, n_keys=self.n_keys * groups if known else None,
            total=self.total * groups if known else self.total,
        )

    def ordered_by(self, *order: str) -> "Axis":
        return replace(self, order=order)

    def window(self) -> WindowSpec:
        return ordered_window(self.keys, self.order)

    def at(self, df: DataFrame) -> Column:
        """One comparable value holding the whole order, for ``min_by`` and ``max_by``.

        A time stamp and a whole number become one decimal, which a hash aggregate can hold;
        a struct would make Spark sort the rows first.
        """
        if len(self.order) == 1:
            return F.col(self.order[0])
        kinds = [df.schema[c].dataType for c in self.order]
        if (
            len(kinds) == 2
            and isinstance(kinds[0], (T.TimestampNTZType, T.TimestampType))
            and isinstance(kinds[1], T.IntegralType)
        ):
            us = F.unix_micros(F.col(self.order[0]).cast("timestamp"))
            return us.cast("decimal(18,0)") * F.lit(Decimal(2**64)) + F.col(self.order[1])
        return F.struct(*self.order)


TICKS = Axis()
DAILY = Axis(order=("date",))
