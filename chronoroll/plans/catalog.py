"""Definitions of tables and views, and how they are read from SQL and YAML."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from ..functions.dims import Dimensions
from ..functions.durations import parse_duration
from ..operators.states import Slot
from .fields import POINTS, Agg, Expr, Field, FieldBuilder, If, Percentile, Raw, Reread, Shift, WeightedMean, children, duration, is_constant
from .parser import Call, Name, Node, Op, Query, QueryError, Star, parse_query, show

HAVING = "_having"


@dataclass(frozen=True)
class Leaf:
    """An aggregate under the conditions of the IFs around it."""

    conds: tuple[Node, ...]
    agg: Agg | WeightedMean | Percentile

    @property
    def key(self) -> str:
        text = self.agg.histogram if isinstance(self.agg, Percentile) else str(self.agg)
        for c in reversed(self.conds):
            text = f"IF({show(c)}, {text})"
        return text


def leaves(e: Expr, conds: tuple[Node, ...] = ()) -> list[Leaf]:
    match e:
        case Agg() | WeightedMean() | Percentile():
            return [Leaf(conds, e)]
        case Reread(of, _):
            return [Leaf(conds, of)]
        case If(cond, of):
            return leaves(of, (*conds, cond))
    return [leaf for kid in children(e) for leaf in leaves(kid, conds)]


@dataclass(frozen=True)
class TableDef:
    name: str
    stream: str
    fields: tuple[Field, ...]
    resolution: int
    retention: int
    where: Node | None = None
    #: Named expressions of dimensions by name; None: all dimensions of the stream.
    dims: tuple[tuple[str, Node], ...] | None = None
    virtual: bool = False
    backfill: int | None = None
    partition_by: tuple[str, ...] = ()
    sql: str = ""

    @property
    def slots(self) -> dict[str, Slot]:
        """One state per distinct aggregate."""
        out: dict[str, Slot] = {}
        for f in self.fields:
            for leaf in leaves(f.expr):
                out.setdefault(leaf.key, Slot(leaf.agg, f"s{len(out)}"))
        return out

    @property
    def leaves(self) -> dict[str, Leaf]:
        return {leaf.key: leaf for f in self.fields for leaf in reversed(leaves(f.expr))}


@dataclass
class Grouping:
    all: bool = False
    dims: tuple[tuple[str, Node], ...] = ()
    period: int | None = None
    stride: int | None = None
    crosstab: Call | None = None


def grouping(q: Query, dims: Dimensions) -> Grouping:
    g, named, none = Grouping(), {}, False
    for node, name in q.group:
        node = dims.expand(node)
        match node:
            case Star():
                g.all = True
            case Name("_"):
                none = True
            case Call("PERIOD" | "STRIDE" as which, args):
                if len(args) != 1:
                    raise QueryError(f"{which} takes one duration")
                us = duration(args[0])
                if us <= 0:
                    raise QueryError(f"{which} must be positive")
                setattr(g, which.lower(), us)
            case Call("CROSSTAB" | "CROSSTABT", _):
                if g.crosstab:
                    raise QueryError("only one crosstab is allowed")
                g.crosstab = node
            case Name(n):
                named[name or n] = node
            case _:
                if not name:
                    raise QueryError(f"{show(node)} in GROUP BY needs a name: use AS")
                named[name] = node
    g.dims = tuple(sorted(named.items()))
    g.all = g.all or not (named or none or g.crosstab)
    return g


def select_fields(q: Query, known: Mapping[str, Expr], dims: Dimensions, star: tuple[Field, ...] | None = None) -> tuple[list[Field], Expr | None]:
    """The fields in order, and the condition of HAVING; of fields with one name the first counts."""
    build = FieldBuilder(known, dims.expand)
    out: dict[str, Field] = {}

    def add(name: str, e: Expr) -> None:
        if name not in out:
            out[name] = Field(name, e)
            build.known[name] = e

    for node, name in q.select:
        node = dims.expand(node)
        match node:
            case Star():
                for f in star if star is not None else tuple(Field(n, e) for n, e in known.items()):
                    add(f.name, f.expr)
            case Name("_") if not name:
                pass
            case Call("CROSSHIFT", args):
                for suffix, e in _crosshift(build, args):
                    base = name or (args[0].name if isinstance(args[0], Name) else None)
                    if not base:
                        raise QueryError("CROSSHIFT of an expression needs a name: use AS")
                    add(base + suffix, e)
            case _:
                if not name and not isinstance(node, Name):
                    raise QueryError(f"{show(node)} needs a name: use AS")
                add(name or node.name, build.build(node))
    having = build.build(dims.expand(q.having)) if q.having is not None else None
    return list(out.values()), having


def _crosshift(build: FieldBuilder, args: tuple[Node, ...]) -> list[tuple[str, Expr]]:
    from ..functions.durations import format_duration

    if len(args) != 3:
        raise QueryError("CROSSHIFT takes 3 arguments")
    of, cutoff, interval = build.build(args[0]), duration(args[1]), abs(duration(args[2]))
    if not cutoff or not interval:
        raise QueryError("cutoff and interval of CROSSHIFT can't be zero")
    sign = -1 if cutoff < 0 else 1
    return [(f"_{format_duration(us)}" if us else "", Shift(of, sign * us)) for us in range(0, abs(cutoff), interval)]


class Catalog:
    def __init__(self, dims: Dimensions) -> None:
        self.dims = dims
        self.tables: dict[str, TableDef] = {}

    def __getitem__(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise QueryError(f"table {name} not found")
        return self.tables[name.lower()]

    def define(self, name: str, sql: str, retention: int, view: bool = False, virtual: bool = False, backfill: int | None = None, partition_by: tuple[str, ...] = (), alter: bool = False) -> TableDef:
        name = name.lower()
        if name in self.tables and not alter:
            raise QueryError(f"table {name} is already there")
        q = parse_query(sql)
        if not isinstance(q.source, str) or q.having or q.order or q.limit or q.offset:
            raise QueryError("a table selects from a stream, without HAVING, ORDER BY, LIMIT and OFFSET")
        g = grouping(q, self.dims)
        if g.crosstab or g.stride:
            raise QueryError("a table can't have CROSSTAB or STRIDE")
        where = self.dims.expand(q.where) if q.where is not None else None
        if view:
            parent = self[q.source]
            known = {f.name: f.expr for f in parent.fields}
            fields = tuple(select_fields(q, known, self.dims, parent.fields)[0])
            own = bool(q.group) and bool(g.dims or g.all and any(isinstance(n, Star) for n, _ in q.group))
            made = TableDef(
                name, parent.stream, fields, g.period or parent.resolution, retention or parent.retention,
                Op("AND", parent.where, where) if parent.where is not None and where is not None else where if where is not None else parent.where,
                (None if g.all else g.dims) if own else parent.dims, virtual, backfill, partition_by or parent.partition_by, sql,
            )
        else:
            if not g.period:
                raise QueryError(f"table {name} needs a period in its GROUP BY")
            fields = tuple(select_fields(q, {}, self.dims, ())[0])
            made = TableDef(name, q.source.strip().lower(), fields, g.period, retention, where, None if g.all else g.dims, virtual, backfill, partition_by, sql)
        points = Field(POINTS, Agg("SUM", Raw(POINTS)))
        if all(f.name != POINTS for f in made.fields):
            made = replace(made, fields=(points, *made.fields))
        if made.retention <= 0:
            raise QueryError(f"table {name} needs a positive retention period")
        if made.retention < made.resolution:
            raise QueryError(f"the retention period of table {name} is shorter than its resolution")
        for f in made.fields:
            if is_constant(f.expr):
                continue
            if any(isinstance(x, Reread) for x in walk(f.expr)):
                raise QueryError(f"{f.name} re-reads a percentile, which only queries can")
        self.tables[name] = made
        return made

    def alter(self, name: str, sql: str) -> TableDef:
        """WHERE and fields are taken from the new SQL, all else stays."""
        old = self[name]
        new = self.define(name, sql, old.retention, False, old.virtual, old.backfill, old.partition_by, alter=True)
        self.tables[name.lower()] = replace(old, where=new.where, fields=new.fields, sql=sql)
        return self.tables[name.lower()]

    def apply_schema(self, text: str) -> list[str]:
        """Tables and views of a YAML schema, parents before views; tables that are there are altered."""
        import yaml

        wanted = {str(k).lower(): v for k, v in (yaml.safe_load(text) or {}).items()}
        parents = {k: str(parse_query(v["sql"]).source).lower() if v.get("view") else None for k, v in wanted.items()}
        done: list[str] = []

        def make(name: str, above: tuple[str, ...] = ()) -> None:
            if name in done:
                return
            if name in above:
                raise QueryError(f"view {name} depends on itself")
            spec, parent = wanted[name], parents[name]
            if parent is not None:
                if parent in wanted:
                    make(parent, (*above, name))
                elif parent not in self.tables:
                    raise QueryError(f"view {name} needs table {parent}, which isn't there")
            us = lambda key: parse_duration(str(spec[key])) if spec.get(key) else None
            inherited = self.tables[parent].retention if parent else 0
            keep = us("retentionperiod") or inherited or (parse_duration("1h") if spec.get("virtual") else 0)
            self.define(name, spec["sql"], keep, bool(spec.get("view")), bool(spec.get("virtual")), us("backfill"), tuple(spec.get("partitionby") or ()), alter=name in self.tables)
            done.append(name)

        for name in sorted(wanted, key=lambda k: (parents[k] is not None, k)):
            make(name)
        return done


def walk(e: Expr) -> list[Expr]:
    return [e, *(x for kid in children(e) for x in walk(kid))]
