"""Mergeable states of aggregates as nullable columns, and values read from them.

SUM, MIN, MAX and COUNT keep one double; means keep the weight and the weighted total;
percentiles keep a histogram, a map from bucket to count that the range and
precision bound. Null: never set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.fields import COMPARE, INFINITE, Agg, Binary, Bounded, Const, Expr, Math, Percentile, Raw, WeightedMean
from ..plans.parser import QueryError

#: Units to one, in sums: four decimals, as products of two prices have; totals are exact to 2 ** 53 units.
UNIT = 1e4


def combine(op: str, a: Column, b: Column) -> Column:
    """Arithmetic on values that may be unset."""
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    if op == "/":
        out = F.when(y != 0, x / F.when(y != 0, y)).when(x == 0, F.lit(0.0)).otherwise(F.lit(INFINITE))
    elif op in COMPARE:
        out = yes({"<": x < y, "<=": x <= y, "=": x == y, "<>": x != y, ">=": x >= y, ">": x > y}[op])
    elif op in ("AND", "OR"):
        out = yes((x > 0) & (y > 0) if op == "AND" else (x > 0) | (y > 0))
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return F.when(a.isNotNull() | b.isNotNull(), out)


def logarithm(kind: str, x: Column) -> Column:
    fn = {"LN": F.ln, "LOG2": F.log2, "LOG10": F.log10}[kind]
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).when(x.isNotNull(), fn(x))


def raw_value(e: Expr, values: dict[str, Column]) -> Column:
    """The value of a point, null if it has none."""
    match e:
        case Raw(n):
            return values.get(n, F.lit(None).cast("double"))
        case Const(v):
            return F.lit(v)
        case Bounded(of, low, high):
            x = raw_value(of, values)
            return F.when((x >= low) & (x <= high), x)
        case Binary(op, a, b):
            return combine(op, raw_value(a, values), raw_value(b, values)) if not isinstance(b, Const) else F.when(raw_value(a, values).isNotNull(), combine(op, raw_value(a, values), raw_value(b, values)))
        case Math(kind, of):
            return logarithm(kind, raw_value(of, values))
    raise QueryError(f"{e} is not a plain value")


@dataclass(frozen=True)
class Slot:
    """Where the state of an aggregate is: the aggregate, and its columns' name."""

    agg: Agg | WeightedMean | Percentile
    name: str

    @property
    def columns(self) -> list[str]:
        return [f"{self.name}_w", f"{self.name}_v"] if isinstance(self.agg, WeightedMean) else [self.name]

    @property
    def is_histogram(self) -> bool:
        return isinstance(self.agg, Percentile)

    def first(self, values: dict[str, Column], cond: Column | None) -> list[Column]:
        """Columns of a single point: what ``merged`` merges, before any grouping."""
        x = raw_value(self.agg.of, values).cast("double")
        x = F.when(cond, x) if cond is not None else x
        if isinstance(self.agg, WeightedMean):
            w = F.coalesce(raw_value(self.agg.weight, values).cast("double"), F.lit(0.0)) if self.agg.weight else F.lit(1.0)
            return [F.when(x.isNotNull(), w), x * w]
        if isinstance(self.agg, Percentile):
            return [F.when(x.isNotNull(), bucket_of(self.agg, x))]
        return [F.when(x.isNotNull(), F.lit(1.0)) if self.agg.kind == "COUNT" else x]

    @property
    def hows(self) -> list[str]:
        """How each column of states is merged (``exact``: see ``split``); histograms are summed per bucket instead."""
        if isinstance(self.agg, WeightedMean):
            return ["exact" if self.agg.weight else "sum", "exact"]
        return [{"MIN": "min", "MAX": "max", "SUM": "exact"}.get(self.agg.kind, "sum") if isinstance(self.agg, Agg) else "sum"]

    def read(self, states: list[Column], at: float | None = None) -> Column:
        """The value of a state, null if unset."""
        if isinstance(self.agg, WeightedMean):
            w, v = states
            return F.when(w.isNotNull(), F.when(w != 0, v / F.when(w != 0, w)).otherwise(F.lit(0.0)))
        if isinstance(self.agg, Percentile):
            return quantile(self.agg, states[0], self.agg.at if at is None else at)
        return states[0]


def split(x: Column) -> tuple[Column, Column]:
    """A number in units of ``UNIT``, null if too large, and the rest: 0 for numbers of so many decimals.

    Whole numbers add up to the same in any order, so what is at a bound doesn't hang on how rows are dealt.
    """
    whole = F.rint(x * UNIT)
    fits = F.abs(whole) < 2.0**52
    return F.when(fits, whole), F.when(fits, x - whole / UNIT).otherwise(x)


def joined(whole: Column, rest: Column) -> Column:
    """The total of numbers from the totals of their parts by ``split``."""
    return rest + F.coalesce(whole, F.lit(0.0)) / UNIT


def bucket_of(p: Percentile, x: Column) -> Column:
    """The bucket of a value, named by the largest whole number that falls in it.

    Values are scaled by the precision, cut to whole numbers and kept to so many significant digits
    that each bucket is at most one unit of the last digit wide.
    """
    digits = min(max(p.precision, 1), 5)
    scale = 10.0**p.precision
    inside = F.when((x >= p.low) & (x <= p.high), x)
    v = F.when(inside * scale >= 0, (inside * scale).cast("long"))
    smallest = int(p.low * scale)
    unit = smallest.bit_length() - 1 if smallest > 0 else 0
    bits = (2 * 10**digits - 1).bit_length()
    # Halves of the width hold all whole numbers exactly; beyond, widths double.
    over = F.length(F.bin(v)) - (unit + bits)
    shift = F.greatest(over, F.lit(0)) + unit
    width = F.pow(F.lit(2.0), shift).cast("long")
    return v - v % width + width - 1


def quantile(p: Percentile, histogram: Column, at: float) -> Column:
    """The first bucket at which the running count reaches the rank, scaled back.

    The rank is part of the walk's start, as what stands inside its step is computed anew for every bucket.
    """
    total = F.aggregate(F.map_values(histogram), F.lit(0).cast("long"), lambda n, x: n + x)
    rank = F.greatest(F.floor(total * (at / 100.0) + 0.5), F.lit(1)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("n"), rank.alias("rank"), F.lit(None).cast("long").alias("v"))

    def step(s: Column, e: Column) -> Column:
        n = s["n"] + e["value"]
        return F.struct(n.alias("n"), s["rank"].alias("rank"), F.when(s["v"].isNotNull(), s["v"]).when(n >= s["rank"], e["key"]).alias("v"))

    walk = F.aggregate(F.sort_array(F.map_entries(histogram)), start, step)
    return F.when(histogram.isNotNull(), walk["v"] / F.lit(10.0**p.precision))


def all_of(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conds) if conds else None
