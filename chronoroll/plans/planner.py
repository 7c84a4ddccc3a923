"""From a query to one lazy DataFrame.

A source is a rollup (states are merged) or a subquery (its rows are points). Over both the
plan is the same: filter, time range, stride, coarser label, one
aggregation by label and dimensions with every aggregate under its conditions, and
then arithmetic, HAVING, order and limits as projections and filters. Where aggregates are shifted, rows
are merged by their own labels first, and only then copied once per distinct shift.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import Dimensions
from ..functions.durations import parse_duration
from ..functions.timegrid import bucket, ceil_us, from_micros, micros
from ..operators.rollup import TIME, aggregated
from ..operators.states import Slot, all_of, combine, logarithm
from .catalog import HAVING, Grouping, Leaf, grouping, select_fields
from .fields import POINTS, Agg, Binary, Bounded, Const, Expr, Field, If, Math, Percentile, Raw, Reread, Shift, WeightedMean, children, fills_gaps, is_constant, when_unset
from .parser import In, Name, Node, Op, Query, QueryError, Str, show

#: The most values of a crosstab.
CROSSTAB_VALUES = 10_000


@dataclass
class Source:
    df: DataFrame
    dims: list[str]
    resolution: int
    as_of: int
    until: int
    #: Known fields by name, stored states by the text of their aggregate; None: rows are points.
    fields: tuple[Field, ...]
    slots: dict[str, Slot] | None
    now: int
    #: The rows of a range of labels, where the source can read less than all.
    within: Callable[[tuple[int, int]], DataFrame] | None = None


@dataclass
class Planned:
    df: DataFrame
    fields: list[Field]
    dims: list[str]
    resolution: int
    as_of: int
    until: int
    steps: list[str] = field(default_factory=list)


@dataclass
class Use:
    """An aggregate as a query needs it: under conditions, at a shift."""

    slot: Slot
    states: list[Column]
    conds: list[Column]
    shift: int
    base: tuple

    def columns(self, name: str) -> list[Column]:
        cond = all_of(self.conds)
        return [(F.when(cond, s) if cond is not None else s).alias(f"{name}_{i}") for i, s in enumerate(self.states)]


class Planner:
    def __init__(self, dims: Dimensions, source_of: Callable[[str, Query], Source], gap_fill: bool | str = "auto", crosstab_values: list[str] | None = None) -> None:
        self.dims, self.source_of, self.gap_fill, self.crosstab_values = dims, source_of, gap_fill, crosstab_values

    def plan(self, q: Query, only_points: bool = False) -> Planned:
        src = self._source(q)
        as_of, until = self._range(q, src)
        g = grouping(q, self.dims)
        res, slice_ = self._resolution(g, src, until - as_of)
        if until - as_of < res:
            as_of = until - res
        known = {f.name: f.expr for f in src.fields} if src.slots is not None else {}
        star = src.fields if src.slots is not None else tuple(Field(f.name, Agg("SUM", Raw(f.name))) for f in src.fields)
        fields, having = select_fields(q, known, self.dims, star)
        if only_points:
            fields = [Field(POINTS, known.get(POINTS, Agg("SUM", Raw(POINTS))))]
        if src.within and not g.crosstab:  # the values of a crosstab come from all rows
            shifts = [least_shift(e) for e in [f.expr for f in fields] + ([having] if having is not None else [])]
            src.df = src.within((as_of + min([0, *shifts]), until))
        steps = [f"source {q.source if isinstance(q.source, str) else 'subquery'}"]
        df = self._where(q, src, steps)
        tab, values = self._crosstab(g, df, src)
        run = _Run(self.dims, src, df)
        outputs = self._outputs(fields, having, g, tab, values, run)
        df = self._in_time(df, src, as_of + min([0, *run.shifts]), until)
        steps.append(f"time range ({as_of}, {until}]")
        names = self._keys(g, src)
        keys = {n: self.dims.column(node, src.df.select(*src.dims).schema).alias(n) for n, node in names}
        if run.shifts:
            steps.append("merge by period")
            df, keys = self._merged(df, keys, run), {n: F.col(f"`{n}`") for n in keys}
            copies = F.explode(F.array(*(F.lit(d).cast("long") for d in sorted({0, *run.shifts}))))
            df = df.withColumn("__d", copies).withColumn("__us", F.col("__us") - F.col("__d"))
            df = df.where((F.col("__us") > as_of) & (F.col("__us") <= until))
            steps.append(f"copies for {len(run.shifts)} shifts")
        if slice_ is not None and res > src.resolution:
            back = (F.lit(until) - F.col("__us")) % F.lit(res)
            df = df.where(back < F.lit(slice_))
            steps.append(f"slices of {slice_} in strides of {res}")
        columns, plain, histograms = [], {}, []
        for use, name in run.uses.values():
            made = use.columns(name)
            if run.shifts:
                made = [F.when(F.col("__d") == use.shift, F.col(c)) for c in run.before(use)]
            own = [f"{name}_{i}" for i in range(len(made))]
            columns += [m.alias(o) for m, o in zip(made, own)]
            if use.slot.is_histogram:
                histograms += own
            else:
                plain |= dict(zip(own, use.slot.hows))
        shaped = df.select(bucket(F.col("__us"), until, res).alias("__b"), *keys.values(), *columns)
        out = aggregated(shaped, ["__b", *keys], plain, histograms)
        steps.append(f"group by {['period', *keys]}")
        if self._gaps(outputs, having):
            out = self._filled(out, list(keys), res)
            steps.append("fill gaps")
        out = self._flat(out, list(keys), outputs)
        if having is not None:
            out = out.where(F.col(HAVING) == 1.0).drop(HAVING)
            steps.append("having")
        fields = [f for f, _ in outputs if f.name != HAVING]
        out = self._ordered(out, q, list(keys), fields)
        return Planned(out, fields, list(keys), res, as_of, until, steps)

    # Where rows come from.

    def _source(self, q: Query) -> Source:
        if isinstance(q.source, str):
            return self.source_of(q.source, q)
        inner = self.plan(q.source)
        now = inner.until
        return Source(inner.df, inner.dims, inner.resolution, inner.as_of, inner.until, tuple(inner.fields), None, now)

    def _moment(self, node: Node, src: Source) -> int:
        text = node.value if isinstance(node, Str) else show(node)
        try:
            at = src.now + parse_duration(text)
        except ValueError:
            from datetime import UTC, datetime

            try:
                t = datetime.fromisoformat(text)
            except ValueError:
                raise QueryError(f"neither a duration nor a time: {text!r}") from None
            t = t if t.tzinfo else t.replace(tzinfo=UTC)
            delta = t - datetime(1970, 1, 1, tzinfo=UTC)
            at = (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
        return ceil_us(at, src.resolution)

    def _range(self, q: Query, src: Source) -> tuple[int, int]:
        until = self._moment(q.until, src) if q.until is not None else src.until
        as_of = self._moment(q.as_of, src) if q.as_of is not None else src.as_of
        if as_of < src.as_of:
            raise QueryError("ASOF is before the start of the table")
        if as_of >= until:
            raise QueryError("ASOF must be before UNTIL")
        return as_of, until

    def _resolution(self, g: Grouping, src: Source, window: int) -> tuple[int, int | None]:
        if g.period is not None and g.period < src.resolution:
            raise QueryError("the period is finer than the table's resolution")
        for us in (g.period, g.stride):
            if us is not None and us % src.resolution:
                raise QueryError("periods and strides must be multiples of the table's resolution")
        if g.stride is not None:
            return g.stride, g.period or src.resolution
        return min(g.period or src.resolution, max(window, src.resolution)), None

    # Rows.

    def _where(self, q: Query, src: Source, steps: list[str]) -> DataFrame:
        df = src.df
        if q.where is None:
            return df
        node = self.dims.expand(q.where)
        rest: list[Node] = []
        marks: dict[int, Column] = {}
        parts = _conjuncts(node)
        for part in parts:
            if isinstance(part, In) and isinstance(part.items, Query) and not part.negated:
                found = self._members(part.items)
                df = df.join(found, self.dims.column(part.of, df.schema) == F.col("__member"), "left_semi")
                steps.append("semi join")
            else:
                rest.append(part)
        for part in rest:
            for inner in _memberships(part):
                name = f"__in{len(marks)}"
                found = self._members(inner.items).select(F.col("__member").alias(f"{name}_v"), F.lit(True).alias(name))
                df = df.join(found, self.dims.column(inner.of, df.schema) == F.col(f"{name}_v"), "left")
                marks[id(inner.items)] = F.coalesce(F.col(name), F.lit(False))
                steps.append("marker join")
        for part in rest:
            df = df.where(F.coalesce(self.dims.column(part, df.schema, marks).cast("boolean"), F.lit(False)))
        steps.append("where")
        return df.drop(*(c for c in df.columns if c.startswith("__in")))

    def _members(self, q: Query) -> DataFrame:
        if len(q.select) != 1 or not isinstance(q.select[0][0], Name):
            raise QueryError("a subquery of IN selects exactly one dimension")
        name = q.select[0][0].name
        inner = self.plan(q, only_points=True)
        if name not in inner.dims:
            raise QueryError(f"{name} is no dimension of the subquery")
        return inner.df.select(F.col(f"`{name}`").alias("__member")).where("__member IS NOT NULL").distinct()

    def _crosstab(self, g: Grouping, df: DataFrame, src: Source) -> tuple[Column | None, list[str]]:
        if not g.crosstab:
            return None, []
        c = self.dims.column(g.crosstab, src.df.select(*src.dims).schema)
        values = self.crosstab_values
        if values is None:  # before the time range is cut, so a value outside it has columns, too
            values = [r[0] for r in df.select(c.alias("v")).distinct().orderBy("v").limit(CROSSTAB_VALUES + 1).collect() if r[0] is not None]
            if len(values) > CROSSTAB_VALUES:
                raise QueryError(f"a crosstab of more than {CROSSTAB_VALUES} values; name them in crosstab_values")
        if len({v.lower() for v in values}) < len(values):
            raise QueryError("values of a crosstab differ only in case")
        return c, sorted(values)

    def _outputs(self, fields: list[Field], having: Expr | None, g: Grouping, tab: Column | None, values: list[str], run: _Run) -> list[tuple[Field, Column]]:
        out: list[tuple[Field, Column]] = []
        if tab is None:
            out = [(f, run.value(f.expr)) for f in fields]
        else:
            for v in values:
                out += [(Field(f"{v.lower()}_{f.name}", f.expr), run.value(f.expr, (tab == v,), f"crosstab {v}")) for f in fields]
            if g.crosstab.name == "CROSSTABT":
                out += [(Field(f"total_{f.name}", f.expr), run.value(f.expr)) for f in fields]
        if having is not None:
            out.append((Field(HAVING, having), run.value(having)))
        return out

    def _in_time(self, df: DataFrame, src: Source, low: int, until: int) -> DataFrame:
        """Rows of the range, by the raw column so that scans can skip."""
        return df.where((F.col(TIME) > from_micros(F.lit(low))) & (F.col(TIME) <= from_micros(F.lit(until)))).withColumn("__us", micros(F.col(TIME)))

    def _merged(self, df: DataFrame, keys: dict[str, Column], run: _Run) -> DataFrame:
        """One row per label and keys before any is copied for a shift: states that differ by their shift alone are merged once."""
        columns, plain, histograms = [], {}, []
        for use, name in run.bases.values():
            made = use.columns(name)
            columns += made
            own = [f"{name}_{i}" for i in range(len(made))]
            if use.slot.is_histogram:
                histograms += own
            else:
                plain |= dict(zip(own, use.slot.hows))
        return aggregated(df.select("__us", *keys.values(), *columns), ["__us", *keys], plain, histograms)

    def _keys(self, g: Grouping, src: Source) -> list[tuple[str, Node]]:
        named = dict(g.dims)
        if g.all:
            named = {d: Name(d) for d in src.dims} | named
        return sorted(named.items())

    # Rows that come out.

    def _gaps(self, outputs: list[tuple[Field, Column]], having: Expr | None) -> bool:
        if self.gap_fill != "auto":
            return bool(self.gap_fill)
        if not any(fills_gaps(f.expr) for f, _ in outputs):
            return False
        return having is None or when_unset(having) == 1.0

    def _filled(self, df: DataFrame, keys: list[str], res: int) -> DataFrame:
        """A row for every period between a key's first and last: each row is followed by the empty ones up to the key's next."""
        after = F.lead("__b").over(Window.partitionBy(*keys).orderBy("__b"))
        rest = [c for c in df.columns if c != "__b" and c not in keys]
        last = F.coalesce(F.col("__next") - F.lit(res), F.col("__b"))
        spread = df.withColumn("__next", after).select(*keys, F.posexplode(F.sequence("__b", last, F.lit(res))).alias("__pos", "__at"), *rest)
        return spread.select(F.col("__at").alias("__b"), *keys, *(F.when(F.col("__pos") == 0, F.col(c)).alias(c) for c in rest))

    def _flat(self, df: DataFrame, keys: list[str], outputs: list[tuple[Field, Column]]) -> DataFrame:
        named = [c.alias(f"__o{k}") for k, (_, c) in enumerate(outputs)]
        df = df.select("__b", *keys, *named)
        set_ = [F.col(f"__o{k}").isNotNull() for k, (f, _) in enumerate(outputs) if not is_constant(f.expr)]
        if outputs:
            some = F.lit(False)
            for s in set_:
                some = some | s
            df = df.where(some)
        return df.select(from_micros(F.col("__b")).alias(TIME), *keys, *(F.coalesce(F.col(f"__o{k}"), F.lit(0.0)).alias(f.name) for k, (f, _) in enumerate(outputs)))

    def _ordered(self, df: DataFrame, q: Query, keys: list[str], fields: list[Field]) -> DataFrame:
        names = {f.name for f in fields} | set(keys) | {TIME}
        for name, _ in q.order:
            if name not in names:
                raise QueryError(f"can't order by {name}: no such field or dimension")
        if q.order:
            df = df.orderBy(*(F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in q.order))
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit else df


class _Run:
    """Collects the aggregates that a query uses, each once, while values are built over their names."""

    def __init__(self, dims: Dimensions, src: Source, df: DataFrame) -> None:
        self.dims, self.src = dims, src
        self.schema = df.select(*src.dims).schema
        self.tops = {str(f.expr) for f in src.fields}
        self.raws = {f.name: F.col(f"`{f.name}`") for f in src.fields} if src.slots is None else {}
        self.uses: dict[tuple, tuple[Use, str]] = {}
        #: One of the uses that differ by their shift alone, for what is merged before rows are copied.
        self.bases: dict[tuple, tuple[Use, str]] = {}
        self.shifts: set[int] = set()

    def value(self, e: Expr, conds: tuple[Column, ...] = (), where: str = "", stored: tuple[Node, ...] | None = None, shift: int = 0) -> Column:
        """A column over the aggregated rows. ``stored``: the conditions within a stored field, None outside of one."""
        if stored is None and self.src.slots is not None and str(e) in self.tops:
            stored = ()
        again = lambda x, **k: self.value(x, **({"conds": conds, "where": where, "stored": stored, "shift": shift} | k))
        match e:
            case Const(v):
                return F.lit(v)
            case Binary(op, a, b):
                return combine(op, again(a), again(b))
            case Math(kind, of):
                return logarithm(kind, again(of))
            case Bounded(of, low, high):
                x = again(of)
                return F.when((x >= low) & (x <= high), x)
            case Shift(of, by):
                by = int(by / self.src.resolution) * self.src.resolution
                return again(of, shift=shift + by)
            case If(cond, of):
                if stored is not None:
                    return again(of, stored=(*stored, cond))
                test = F.coalesce(self.dims.column(cond, self.schema).cast("boolean"), F.lit(False))
                return again(of, conds=(*conds, test), where=f"{where} {show(cond)}")
            case Reread(of, at):
                return self._aggregate(of, conds, where, stored if stored is not None else (), shift, at)
            case Agg() | WeightedMean() | Percentile():
                return self._aggregate(e, conds, where, stored, shift, None)
        raise QueryError(f"can't compute {e}")

    def before(self, use: Use) -> list[str]:
        """The columns of a use in the rows that are merged before they are copied."""
        return [f"{self.bases[use.base][1]}_{i}" for i in range(len(use.states))]

    def _aggregate(self, agg: Agg | WeightedMean | Percentile, conds: tuple[Column, ...], where: str, stored: tuple[Node, ...] | None, shift: int, at: float | None) -> Column:
        unset = F.lit(None).cast("double")
        if shift > 0:
            return unset
        key = Leaf(stored or (), agg).key
        if self.src.slots is None:
            slot = Slot(agg, "x")
            states = slot.first({n: c.cast("double") for n, c in self.raws.items()}, None)
        else:
            if stored is None and isinstance(agg, Percentile):
                stored = () if key in self.src.slots else None
            if stored is None or key not in self.src.slots:
                return unset
            slot = self.src.slots[key]
            states = [F.col(c) for c in slot.columns]
        if shift:
            self.shifts.add(shift)
        use = Use(slot, states, list(conds), shift, (key, where))
        self.bases.setdefault(use.base, (use, f"b{len(self.bases)}"))
        _, name = self.uses.setdefault((key, where, shift), (use, f"q{len(self.uses)}"))
        own = Slot(agg, name)
        return own.read([F.col(f"{name}_{i}") for i in range(len(states))], at)


def least_shift(e: Expr) -> int:
    """The farthest that an expression looks back, in microseconds below 0."""
    return min([0, *map(least_shift, children(e))]) + (min(e.by, 0) if isinstance(e, Shift) else 0)


def _conjuncts(node: Node) -> list[Node]:
    if isinstance(node, Op) and node.op == "AND" and node.right is not None:
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [node]


def _memberships(node: Node | None) -> list[In]:
    match node:
        case In(_, items, _) if isinstance(items, Query):
            return [node]
        case Op(_, a, b):
            return _memberships(a) + _memberships(b)
    return []


__all__ = ["Planned", "Planner", "Source"]
