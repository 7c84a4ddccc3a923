"""Functions of dimensions, as Spark columns: usable in WHERE, GROUP BY and conditions of IF.

Where a function's meaning is only known by name, it follows Spark: CONCAT skips nulls,
ANY is the first value that isn't null, DECODE without a default gives null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import Call, Hole, In, IsNull, Name, Node, Num, Op, QueryError, Query, Star, Str, parse_expression

#: The largest mapping that may become a literal in a plan.
MAPPING_ROWS = 10_000


def _text(c: Column) -> Column:
    return c.cast("string")


def _decode(x: Column, *rest: Column) -> Column:
    out = rest[-1] if len(rest) % 2 else F.lit(None)
    for k in range(len(rest) - len(rest) % 2 - 2, -1, -2):
        out = F.when(_text(x) == _text(rest[k]), _text(rest[k + 1])).otherwise(_text(out))
    return out


#: name: (fewest arguments, most or None, builder); literal arguments come as Python values where a builder asks for them.
BUILTIN: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "RAND": (0, 0, lambda: F.rand()),
    "LEN": (1, 1, lambda s: F.length(_text(s))),
    "SPLIT": (3, 3, lambda s, by, k: F.get(F.split(_text(s), F.concat(F.lit(r"\Q"), _text(by), F.lit(r"\E"))), k.cast("int"))),
    "SUBSTR": (3, 3, lambda s, at, n: F.substring(_text(s), at.cast("int") + 1, n.cast("int"))),
    "REPLACEALL": (3, 3, lambda s, pattern, by: F.regexp_replace(_text(s), pattern, by)),
    "CONCAT": (2, None, lambda by, *parts: F.concat_ws(by, *map(_text, parts))),
    "CROSSTAB": (1, None, lambda *parts: F.concat_ws("_", *map(_text, parts))),
    "CROSSTABT": (1, None, lambda *parts: F.concat_ws("_", *map(_text, parts))),
    "ANY": (1, None, lambda *xs: F.coalesce(*map(_text, xs))),
    "ARRAY": (0, None, lambda *xs: F.array(*map(_text, xs))),
    "DECODE": (3, None, _decode),
}
#: Lookups that need a provider.
LOOKUPS = ("CITY", "REGION", "REGION_CITY", "COUNTRY_CODE", "ISP", "ORG", "ASN", "ASNAME", "HGET", "SISMEMBER", "LUA")


def from_mapping(mapping: Mapping[str, str]) -> Callable[[Column], Column]:
    """A lookup in a small mapping, as a literal of the plan."""
    if len(mapping) > MAPPING_ROWS:
        raise QueryError(f"a mapping of {len(mapping)} rows is too large for a plan; register a callable")
    pairs = [F.lit(str(x)) for kv in mapping.items() for x in kv]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return lambda key: F.try_element_at(table, _text(key))


def from_callable(fn: Callable[..., object], kind: str = "string") -> Callable[..., Column]:
    """A lookup by a Python function of texts, in Arrow batches."""

    def build(*cols: Column) -> Column:
        @F.pandas_udf(kind)
        def look(*series):  # type: ignore[no-untyped-def]
            import pandas as pd

            return pd.Series([fn(*x) for x in zip(*series)], dtype=object if kind == "string" else None)

        return look(*map(_text, cols))

    return build


def _table(rows: Mapping[tuple[str, str], object]) -> Callable[[Column, Column], Column]:
    """A literal of pairs, for a lookup by two texts."""
    if len(rows) > MAPPING_ROWS:
        raise QueryError(f"a mapping of {len(rows)} rows is too large for a plan; register a callable")
    table = F.create_map(*(F.lit(x) for (a, b), v in rows.items() for x in (f"{a}\x00{b}", str(v)))) if rows else F.create_map().cast("map<string,string>")
    return lambda a, b: F.try_element_at(table, F.concat(_text(a), F.lit("\x00"), _text(b)))


def from_hashes(hashes: Mapping[str, Mapping[str, object]]) -> Callable[[Column, Column], Column]:
    """A provider of HGET(hash, key)."""
    return _table({(h, k): v for h, own in hashes.items() for k, v in own.items()})


def from_sets(sets: Mapping[str, Iterable[object]]) -> Callable[[Column, Column], Column]:
    """A provider of SISMEMBER(set, member)."""
    found = _table({(s, str(m)): "" for s, own in sets.items() for m in own})
    return lambda s, m: found(s, m).isNotNull()


def from_scripts(scripts: Mapping[str, Callable[[list, list], object]]) -> Callable[[Column, Column, Column], Column]:
    """A provider of LUA(script, ARRAY(keys), ARRAY(args)): Python functions by name, in Arrow batches."""

    def build(script: Column, keys: Column, args: Column) -> Column:
        @F.pandas_udf("string")
        def call(names, keys_, args_):  # type: ignore[no-untyped-def]
            import pandas as pd

            return pd.Series([None if n not in scripts else None if (x := scripts[n](list(k), list(a))) is None else str(x) for n, k, a in zip(names, keys_, args_)], dtype=object)

        return call(_text(script), keys, args)

    return build


class Dimensions:
    """The registry of functions and aliases, and the way from trees to columns."""

    def __init__(self) -> None:
        self.functions = dict(BUILTIN)
        self.aliases: dict[str, Node] = {}

    def register(self, name: str, build: Callable[..., Column], least: int = 1, most: int | None = 1) -> None:
        if name.upper() in self.functions:
            raise QueryError(f"function {name} is already there")
        self.functions[name.upper()] = least, most, build

    def alias(self, name: str, template: str) -> None:
        self.aliases[name.upper()] = parse_expression(template)

    def load_aliases(self, text: str) -> None:
        """Lines of ``NAME = template``."""
        for line in text.splitlines():
            if (m := re.match(r"\s*([A-Za-z_]\w*)\s*=\s*(.+?)\s*$", line)) and not line.lstrip().startswith("#"):
                self.alias(m[1], m[2])

    def expand(self, node: Node) -> Node:
        """Aliases in place of their calls."""
        match node:
            case Call(name, args):
                args = tuple(map(self.expand, args))
                if name in self.aliases:
                    fill = iter(args)
                    out = self.expand(_filled(self.aliases[name], fill))
                    if next(fill, None) is not None:
                        raise QueryError(f"alias {name} has fewer places than arguments")
                    return out
                return Call(name, args)
            case Op(op, left, right):
                return Op(op, self.expand(left), right and self.expand(right))
            case IsNull(of, negated):
                return IsNull(self.expand(of), negated)
            case In(of, items, negated):
                return In(self.expand(of), items if isinstance(items, Query) else tuple(map(self.expand, items)), negated)
        return node

    def column(self, node: Node, schema: T.StructType, memberships: Mapping[int, Column] | None = None) -> Column:
        """``memberships``: columns for IN over subqueries, by their identity."""
        go = lambda n: self.column(n, schema, memberships)
        kinds = {f.name.lower(): f.dataType for f in schema}
        match node:
            case Name(n):
                if n in kinds:
                    return F.col(f"`{n}`")
                if n in ("true", "t", "false", "f"):
                    return F.lit(n[0] == "t")
                return F.lit(None)
            case Num(v) | Str(v):
                return F.lit(v)
            case Op("AND", a, b) if b:
                return go(a) & go(b)
            case Op("OR", a, b) if b:
                return go(a) | go(b)
            case Op("NOT", a):
                return ~go(a)
            case Op("LIKE" | "NOT LIKE" as op, a, Str(v)):
                like = _text(go(a)).like(v)
                return like if op == "LIKE" else ~like
            case Op("=" | "<>" | "<" | "<=" | ">" | ">=" as op, a, b) if b:
                x, y = self._alike(a, b, go, kinds)
                return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            case IsNull(of, negated):
                return go(of).isNotNull() if negated else go(of).isNull()
            case In(of, items, negated):
                if isinstance(items, Query):
                    if not memberships or id(items) not in memberships:
                        raise QueryError("IN over a subquery is only allowed in WHERE")
                    found = memberships[id(items)]
                else:
                    found = F.lit(False)
                    for item in items:
                        found = found | self.column(Op("=", of, item), schema)
                return ~found if negated else found
            case Call(name, args):
                return self._call(name, args, go)
            case Star() | Hole():
                raise QueryError("a wildcard is not allowed here")
        raise QueryError(f"arithmetic on dimensions is not supported: {node}")

    def _alike(self, a: Node, b: Node, go: Callable[[Node], Column], kinds: Mapping[str, T.DataType]) -> tuple[Column, Column]:
        """Both sides in one type: numbers against texts are compared as numbers where they are some."""
        x, y = go(a), go(b)

        def kind(n: Node) -> str:
            if isinstance(n, Num):
                return "number"
            if isinstance(n, Str):
                return "text"
            if isinstance(n, Name):
                k = kinds.get(n.name)
                if k is None:
                    return "bool" if n.name in ("true", "t", "false", "f") else "any"
                return "number" if isinstance(k, T.NumericType) else "bool" if isinstance(k, T.BooleanType) else "text" if isinstance(k, T.StringType) else "other"
            return "text" if isinstance(n, Call) and n.name not in ("RAND", "LEN") else "number"

        left, right = kind(a), kind(b)
        if {left, right} == {"number", "text"}:
            return (x if left == "number" else x.try_cast("double")), (y if right == "number" else y.try_cast("double"))
        if "bool" in (left, right) and left != right and "any" not in (left, right):
            return _text(x), _text(y)
        return x, y

    def _call(self, name: str, args: tuple[Node, ...], go: Callable[[Node], Column]) -> Column:
        found = self.functions.get(name)
        if not found and name.startswith("P"):  # marks a one-to-one expression; the value is the same
            found = self.functions.get(name[1:])
        if not found:
            if name in LOOKUPS or name[1:] in LOOKUPS:
                raise QueryError(f"{name} needs a provider: register one")
            raise QueryError(f"unknown function {name}")
        least, most, build = found
        if len(args) < least or (most is not None and len(args) > most):
            raise QueryError(f"{name} takes {least}{'' if most == least else ' or more'} arguments")
        plain = name.removeprefix("P") if name not in self.functions else name
        if plain == "CONCAT" and isinstance(args[0], Str):
            return build(args[0].value, *map(go, args[1:]))
        if plain == "REPLACEALL" and isinstance(args[1], Str) and isinstance(args[2], Str):
            return build(go(args[0]), args[1].value, args[2].value)
        return build(*map(go, args))


def _filled(node: Node, fill) -> Node:  # type: ignore[no-untyped-def]
    match node:
        case Hole():
            try:
                return next(fill)
            except StopIteration:
                raise QueryError("an alias has more places than arguments") from None
        case Call(name, args):
            return Call(name, tuple(_filled(a, fill) for a in args))
        case Op(op, left, right):
            return Op(op, _filled(left, fill), right and _filled(right, fill))
        case IsNull(of, negated):
            return IsNull(_filled(of, fill), negated)
        case In(of, items, negated) if not isinstance(items, Query):
            return In(_filled(of, fill), tuple(_filled(i, fill) for i in items), negated)
    return node
