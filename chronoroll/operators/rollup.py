"""From points to states: filter, slice dimensions, label, and aggregate partially and finally."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import Dimensions
from ..functions.timegrid import ceil_micros, from_micros, micros
from ..plans.catalog import TableDef
from ..plans.fields import POINTS
from .states import all_of, joined, split

TIME = "_time"


def spread_arrays(df: DataFrame, vals: Iterable[str], tail_copies: int = 1) -> DataFrame:
    """One row per element of array values: the first stays with its point, the others are points of their own,
    each as often as ``tail_copies`` says."""
    vals = list(vals)
    arrays = [v for v in vals if isinstance(df.schema[v].dataType, T.ArrayType)]
    if not arrays:
        return df
    empty = {v: F.lit(None).cast("double").alias(v) for v in vals}
    plain = {v: (F.get(F.col(v), F.lit(0)) if v in arrays else F.col(v)).cast("double").alias(v) for v in vals}
    points = [F.array(F.struct(*plain.values()))]

    def alone(v: str):  # type: ignore[no-untyped-def]
        return lambda x: F.struct(*(x.cast("double").alias(n) if n == v else c for n, c in empty.items()))

    for v in arrays:
        rest = F.when(F.size(v) > 1, F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))).otherwise(F.array().cast(df.schema[v].dataType))
        extra = F.transform(rest, alone(v))
        points += tail_copies * [F.coalesce(extra, F.array().cast(T.ArrayType(T.StructType([T.StructField(n, T.DoubleType()) for n in vals]))))]
    rest_of = [c for c in df.columns if c not in vals]
    return df.select(*rest_of, F.explode(F.concat(*points)).alias("__point")).select(*rest_of, *(F.col("__point")[v].alias(v) for v in vals))


def aggregated(df: DataFrame, keys: list[str], plain: dict[str, str], histograms: list[str]) -> DataFrame:
    """Group by ``keys``, reading ``df`` once. ``plain``: columns and how each is merged; ``histograms``: columns of buckets, or of maps to merge.

    Columns that are merged exactly are summed in two parts.

    Histograms are counted per bucket first, so a group is never gathered as a list of points; plain columns are merged
    partially along with them, then by keys alone.
    """
    rests = {c: f"{c}__rest" for c, kind in plain.items() if kind == "exact"}
    if rests:
        parts = {c: split(F.col(c)) for c in rests}
        df = df.withColumns({c: whole for c, (whole, _) in parts.items()} | {rests[c]: rest for c, (_, rest) in parts.items()})
        out = aggregated(df, keys, plain | dict.fromkeys([*rests, *rests.values()], "sum"), histograms)
        return out.withColumns({c: joined(F.col(c), F.col(rest)) for c, rest in rests.items()}).drop(*rests.values())
    how = lambda: [getattr(F, kind)(c).alias(c) for c, kind in plain.items()]
    if not histograms:
        return df.groupBy(*keys).agg(*(how() or [F.count(F.lit(1)).alias("__rows")]))
    kinds = {f.name: f.dataType for f in df.schema}
    none = {c: F.lit(None).cast(kinds[c]).alias(c) for c in plain}
    of = lambda slot, bucket, n, rest: F.struct(F.lit(slot).alias("__slot"), bucket.cast("long").alias("__k"), n.cast("long").alias("__n"), *rest)
    if len(histograms) == 1 and not isinstance(kinds[histograms[0]], T.MapType):
        h = F.col(histograms[0])
        long = df.select(*keys, F.lit(0).alias("__slot"), h.alias("__k"), F.when(h.isNotNull(), 1).cast("long").alias("__n"), *plain)
    else:
        entries_of = lambda slot: lambda e: of(slot, e["key"], e["value"], none.values())
        whole = F.array(of(0, F.lit(None), F.lit(None), [F.col(c) for c in plain]))
        empty = F.slice(whole, 1, 0)
        for slot, name in enumerate(histograms):
            if isinstance(kinds[name], T.MapType):
                found = F.coalesce(F.transform(F.map_entries(name), entries_of(slot)), empty)
            else:
                found = F.when(F.col(name).isNotNull(), F.array(of(slot, F.col(name), F.lit(1), none.values()))).otherwise(empty)
            whole = F.concat(whole, found)
        long = df.select(*keys, F.explode(whole).alias("__p")).select(*keys, "__p.*")
    counted = long.groupBy(*keys, "__slot", "__k").agg(*how(), F.sum("__n").alias("__n"))
    entry = lambda slot: F.when((F.col("__slot") == slot) & F.col("__n").isNotNull(), F.struct("__k", "__n"))
    listed = counted.groupBy(*keys).agg(*how(), *(F.collect_list(entry(slot)).alias(name) for slot, name in enumerate(histograms)))
    return listed.select(*keys, *plain, *(F.when(F.size(name) > 0, F.map_from_entries(name)).alias(name) for name in histograms))


def table_dims(table: TableDef, columns: Iterable[str], ts: str, vals: Iterable[str]) -> list[str]:
    if table.dims is not None:
        return [n for n, _ in table.dims]
    return [c for c in columns if c != ts and c not in set(vals)]


def rollup(df: DataFrame, table: TableDef, dims: Dimensions, ts: str, vals: list[str], now: int | None, tail_copies: int = 1, merged: bool = True, within: tuple[int, int] | None = None) -> DataFrame:
    """``_time``, dimensions and state columns of a table, from points of its stream.

    ``now``: microseconds; points older than the retention period are left out, none if it is None.
    ``merged``: one row per label and dimensions; else one per point, for a query that merges anyway.
    ``within``: labels wanted, (from, to]; on the table's grid that is a range of timestamps, which the scan can skip by.
    """
    if within is not None:
        df = df.where((F.col(ts) > from_micros(F.lit(within[0]))) & (F.col(ts) <= from_micros(F.lit(within[1]))))
    if now is not None:
        oldest = now - table.retention
        if table.backfill is not None:
            oldest = max(oldest, now - table.backfill)
        df = df.where(F.col(ts) >= from_micros(F.lit(oldest)))
    if table.where is not None:
        df = df.where(F.coalesce(dims.column(table.where, df.schema), F.lit(False)))
    df = spread_arrays(df, vals, tail_copies)
    names = table_dims(table, df.columns, ts, vals)
    made = dict(table.dims) if table.dims is not None else {}
    values = {v: F.col(f"`{v}`").cast("double") for v in vals}
    values[POINTS] = F.coalesce(values.get(POINTS, F.lit(None)), F.lit(1.0))
    states, slots = [], table.slots
    for key, leaf in table.leaves.items():
        cond = all_of([F.coalesce(dims.column(c, df.schema), F.lit(False)) for c in leaf.conds])
        states += [c.alias(n) for c, n in zip(slots[key].first(values, cond), slots[key].columns)]
    rows = df.select(
        from_micros(ceil_micros(micros(F.col(ts)), table.resolution)).alias(TIME),
        *((dims.column(made[n], df.schema) if n in made else F.col(f"`{n}`")).alias(n) for n in names),
        *states,
    )
    return merge(rows, table, names) if merged else rows


def merge(rows: DataFrame, table: TableDef, names: list[str]) -> DataFrame:
    """States merged by label and dimensions: for points as for partial rollups."""
    plain = {c: how for slot in table.slots.values() if not slot.is_histogram for c, how in zip(slot.columns, slot.hows)}
    out = aggregated(rows, [TIME, *names], plain, [slot.name for slot in table.slots.values() if slot.is_histogram])
    return out.select(TIME, *(f"`{n}`" for n in names), *(c for s in table.slots.values() for c in s.columns))
