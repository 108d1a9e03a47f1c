"""Rolling values whose cost does not depend on the length of the frame.

Rows are cut into blocks of the frame's length n. A frame that ends in slot s of a block is the last n - 1 - s rows of the
block before and the first s + 1 rows of its own, so two running states meet: one that runs forward through a block, and
one that runs backward, fetched from n - 1 rows ago. States merge without any subtraction (counts and sums add, extremes
are compared, moments merge by Chan's formula), so nothing cancels. Values are centred on their block's first known value
before they are squared, which costs no precision where prices are large and their moves small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("count", "sum", "mean", "var", "std", "min", "max", "cov", "slope")


@dataclass(frozen=True)
class Rolling:
    """``kind`` of ``x`` over the last ``n`` rows up to ``skip`` rows before the current one.

    The value is missing until ``need`` (default ``n``) known values are in the frame. ``cov`` and ``slope`` take the pairs
    with ``y`` where both are known; ``slope`` is that of x over y. Variances and covariances are those of a sample.
    """

    kind: str
    x: str
    n: int
    y: str | None = None
    need: int | None = None
    skip: int = 0

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown rolling value {self.kind!r}: choose from {', '.join(KINDS)}")
        if self.n < 1 or self.skip < 0:
            raise ValueError("a frame holds one row at least and ends at the current row or before")
        if (self.kind in ("cov", "slope")) != (self.y is not None):
            raise ValueError("cov and slope take a second column, other kinds do not")

    @property
    def series(self) -> tuple:
        """What a state is kept for: (frame length, column, second column)."""
        return self.n, self.x, self.y


#: State of one series: how its parts are aggregated, from the centred columns ``_cx`` and ``_cy`` of the block.
_PARTS = {
    "count": {"n"}, "sum": {"n", "sum"}, "mean": {"n", "mx"}, "var": {"n", "mx", "xx"}, "std": {"n", "mx", "xx"}, "min": {"n", "min"},
    "max": {"n", "max"}, "cov": {"n", "mx", "my", "xy"}, "slope": {"n", "mx", "my", "yy", "xy"},
}


def _state(x: Column, y: Column | None, raw: Column, frame: WindowSpec) -> dict[str, Column]:
    count = F.count(x).over(frame)
    state = {"n": count, "sum": F.sum(raw).over(frame), "mx": F.avg(x).over(frame), "xx": F.var_pop(x).over(frame) * count, "min": F.min(raw).over(frame), "max": F.max(raw).over(frame)}
    if y is not None:
        state |= {"my": F.avg(y).over(frame), "yy": F.var_pop(y).over(frame) * count, "xy": F.covar_pop(x, y).over(frame) * count}
    return state


def _merged(a, b, parts: set[str]) -> dict[str, Column]:
    """The state of two neighbouring stretches; either may hold no known value."""
    na, nb = F.coalesce(a("n"), F.lit(0)), b("n")
    out = {"n": na + nb}
    either = lambda p, both: F.when(na == 0, b(p)).when(nb == 0, a(p)).otherwise(both)
    # from one mean to the other; the difference of the centres is exact where they are close
    step = {m: (b(f"c{m[1]}") - a(f"c{m[1]}")) + (b(m) - a(m)) for m in ("mx", "my") if m in parts}
    for p in parts - {"n"}:
        if p == "sum":
            out[p] = F.coalesce(a(p) + b(p), a(p), b(p))
        elif p in ("min", "max"):
            out[p] = (F.least if p == "min" else F.greatest)(a(p), b(p))
        elif p in ("mx", "my"):
            out[p] = F.when(na == 0, b(f"c{p[1]}") + b(p)).when(nb == 0, a(f"c{p[1]}") + a(p)).otherwise(a(f"c{p[1]}") + (a(p) + step[p] * (nb / (na + nb))))
        else:
            first, second = step["m" + p[0]], step["m" + p[1]]
            out[p] = either(p, a(p) + b(p) + first * second * (na * nb / (na + nb)))
    return out


def _value(kind: str, s: dict[str, Column]) -> Column:
    several = s["n"] > 1
    return {
        "count": lambda: s["n"], "sum": lambda: s["sum"], "mean": lambda: s["mx"], "min": lambda: s["min"], "max": lambda: s["max"],
        "var": lambda: F.when(several, s["xx"] / (s["n"] - 1)), "std": lambda: F.when(several, F.sqrt(s["xx"] / (s["n"] - 1))),
        "cov": lambda: F.when(several, s["xy"] / (s["n"] - 1)), "slope": lambda: F.when(several & (s["yy"] > 0), s["xy"] / s["yy"]),
    }[kind]()


def with_rolling(df: DataFrame, w: WindowSpec, **values: Rolling) -> DataFrame:
    """Add the rolling ``values`` over ``w``, the window that ``over_rows`` gives to its ``build`` (or ``Axis.window()``).

    All lengths share one exchange. Each length sorts the rows of a key twice, whatever the number of values. NULLs are
    skipped and count for nothing; a new column replaces one of its name.
    """
    kept = [c for c in df.columns if c not in values]
    d = df.withColumn("_at", (F.row_number().over(w) - 1).cast("bigint"))
    for n in sorted({v.n for v in values.values()}):
        series = sorted({v.series for v in values.values() if v.n == n}, key=str)
        parts = {s: set().union(*[_PARTS[v.kind] for v in values.values() if v.series == s]) for s in series}
        block = W.partitionBy(*w.parts, "_block")
        whole = block.orderBy("_at").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        d = d.withColumn("_block", F.expr(f"_at div {n}L"))
        names = {s: f"_{n}_{i}" for i, s in enumerate(series)}
        centred, back, fore, fetched = {}, {}, {}, {}
        for s in series:
            known = F.lit(True) if s[2] is None else F.col(s[1]).isNotNull() & F.col(s[2]).isNotNull()
            for axis, c in (("x", s[1]), ("y", s[2])):
                if f"m{axis}" in parts[s]:
                    value = F.when(known, F.col(c).cast("double"))
                    centred[f"{names[s]}_c{axis}"] = F.first(value, ignorenulls=True).over(whole)
                    centred[f"{names[s]}_{axis}"] = value - F.first(value, ignorenulls=True).over(whole)
        d = d.withColumns(centred)
        for s in series:
            known = F.lit(True) if s[2] is None else F.col(s[1]).isNotNull() & F.col(s[2]).isNotNull()
            # counts need no centre
            x = F.col(f"{names[s]}_x") if "mx" in parts[s] else F.when(known, F.col(s[1]))
            y = F.col(f"{names[s]}_y") if "my" in parts[s] else None
            for side, order, into in (("b", F.col("_at").desc(), back), ("f", F.col("_at"), fore)):
                state = _state(x, y, F.when(known, F.col(s[1])), block.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
                into |= {f"{names[s]}_{side}_{p}": state[p] for p in parts[s]}
            carried = [f"{names[s]}_b_{p}" for p in sorted(parts[s])] + [f"{names[s]}_c{p[1]}" for p in sorted(parts[s]) if p in ("mx", "my")]
            for c in carried:
                name = c if "_b_" in c else c.replace(f"{names[s]}_", f"{names[s]}_b_")
                # same sort as the forward states; a frame that ends with its block has no part in the block before
                earlier = F.lag(c, n - 1).over(W.partitionBy(*w.parts).orderBy("_block", "_at"))
                fetched[name] = F.when(F.col("_at") % n != n - 1, earlier)
        d = d.withColumns(back).withColumns(fore)
        d = d.withColumns({f"{c}_": v for c, v in fetched.items()})
        out = {}
        for name, v in values.items():
            if v.n != n:
                continue
            base = names[v.series]
            earlier = lambda p, base=base: F.col(f"{base}_b_{p}_")
            own = lambda p, base=base: F.col(f"{base}_{p}" if p in ("cx", "cy") else f"{base}_f_{p}")
            state = _merged(earlier, own, parts[v.series])
            need = v.n if v.need is None else v.need
            value = F.when(state["n"] >= max(need, 0 if v.kind == "count" else 1), _value(v.kind, state))
            out[f"_out_{name}"] = value
        d = d.withColumns(out)
        shifted = {f"_out_{name}": F.lag(f"_out_{name}", v.skip).over(W.partitionBy(*w.parts).orderBy("_block", "_at")) for name, v in values.items() if v.n == n and v.skip}
        d = d.withColumns(shifted) if shifted else d
        d = d.select(*kept, "_at", *[f"_out_{name}" for name, v in values.items() if v.n <= n])
    return d.select(*kept, *[F.col(f"_out_{name}").alias(name) for name in values])
