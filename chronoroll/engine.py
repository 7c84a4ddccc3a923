"""The engine: streams, tables and views, queries, and what is kept of them."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.dims import Dimensions
from .functions.durations import parse_duration
from .functions.timegrid import ceil_us, from_micros, micros
from .operators.rollup import TIME, merge, rollup, spread_arrays, table_dims
from .plans.catalog import Catalog, TableDef
from .plans.parser import Query, QueryError, parse_query
from .plans.planner import Planned, Planner, Source

T = TypeVar("T")


@dataclass
class Stream:
    df: DataFrame
    ts: str
    vals: list[str]


class Engine:
    """``now``: microseconds since 1970 or None for virtual time, the latest timestamp that a table takes in.

    ``array_tail_copies``: how often an element of an array value counts that isn't its first.
    """

    def __init__(self, spark: SparkSession, now: int | None = None, whitelist: Iterable[str] | None = None, cache_ttl: float = 7200.0, array_tail_copies: int = 1) -> None:
        self.spark, self.now, self.array_tail_copies = spark, now, array_tail_copies
        self.whitelist = set(whitelist) if whitelist is not None else None
        self.dims = Dimensions()
        self.catalog = Catalog(self.dims)
        self.streams: dict[str, Stream] = {}
        self.stored: dict[str, Callable[[bool], DataFrame]] = {}
        self.cache_ttl, self._cache = cache_ttl, {}
        self._times: dict[str, int] = {}
        self._rewrites: dict[str, Callable[[DataFrame], DataFrame]] = {}

    # Streams.

    def add_stream(self, name: str, df: DataFrame, ts: str = "ts", vals: Iterable[str] = ("value",)) -> None:
        """A DataFrame as a stream: its timestamp, its values; all other columns are dimensions."""
        vals = list(vals)
        df = df.select(*(F.col(f"`{c}`").alias(c.lower()) for c in df.columns))
        ts, vals = ts.lower(), [v.lower() for v in vals]
        for v in vals:  # other kinds can't be values
            kind = df.schema[v].dataType.simpleString()
            if kind in ("boolean", "string", "binary", "date", "timestamp", "timestamp_ntz"):
                df = df.withColumn(v, F.lit(None).cast("double"))
        if self.whitelist is not None:
            df = df.select(*(c for c in df.columns if c == ts or c in vals or c in self.whitelist))
        self.streams[name.strip().lower()] = Stream(df, ts, vals)
        self._times.clear()

    def insert(self, name: str, points: Iterable[tuple[object, dict, dict]]) -> None:
        """Points (ts, dims, vals) appended to a stream; for tests and small inputs."""
        from .sources.points import from_tuples

        df, vals = from_tuples(self.spark, points)
        old = self.streams.get(name.strip().lower())
        if old:
            df = old.df.withColumnRenamed(old.ts, "ts").unionByName(df, allowMissingColumns=True)
            vals = sorted({*old.vals, *vals})
        self.add_stream(name, df, "ts", vals)

    # Definitions.

    def create_table(self, name: str, sql: str, retention: str = "36500d", **options: object) -> TableDef:
        backfill = options.pop("backfill", None)
        return self.catalog.define(name, sql, parse_duration(retention), backfill=parse_duration(str(backfill)) if backfill else None, **options)  # type: ignore[arg-type]

    def create_view(self, name: str, sql: str, retention: str = "0", **options: object) -> TableDef:
        return self.create_table(name, sql, retention, view=True, **options)

    def alter_table(self, name: str, sql: str) -> TableDef:
        self._times.pop(name.lower(), None)
        return self.catalog.alter(name, sql)

    def apply_schema(self, text: str) -> list[str]:
        return self.catalog.apply_schema(text)

    def rewrite_rows(self, name: str, rewrite: Callable[[DataFrame], DataFrame] | None) -> None:
        """What queries read of a table: its rows (``_time``, dimensions, states) as ``rewrite`` leaves them; the stored states stay as they are."""
        if rewrite is None:
            self._rewrites.pop(name.lower(), None)
        else:
            self._rewrites[name.lower()] = rewrite

    # Tables.

    def _stream(self, table: TableDef) -> Stream:
        if table.stream not in self.streams:
            raise QueryError(f"stream {table.stream} not found")
        return self.streams[table.stream]

    def clock(self, name: str) -> int:
        """Now, in microseconds: as given, or the latest timestamp that the table's WHERE lets pass."""
        if self.now is not None:
            return self.now
        table = self.catalog[name]
        if name.lower() not in self._times:
            if name.lower() in self.stored:
                latest = self.stored[name.lower()](True).agg(F.max(TIME).alias("at")).select(micros(F.col("at"))).first()[0]
            else:
                s = self._stream(table)
                df = s.df
                if table.where is not None:
                    df = df.where(F.coalesce(self.dims.column(table.where, df.schema), F.lit(False)))
                latest = df.agg(F.max(F.col(s.ts)).alias("at")).select(micros(F.col("at"))).first()[0]
            self._times[name.lower()] = latest if latest is not None else 0
        return self._times[name.lower()]

    def rollup(self, name: str) -> DataFrame:
        """The states of a table, from its stream."""
        table = self.catalog[name]
        s = self._stream(table)
        return rollup(s.df, table, self.dims, s.ts, s.vals, self.clock(name), self.array_tail_copies)

    def materialize(self, name: str, path: str) -> None:
        """Write a table's states by day, sorted, and read them from there from now on."""
        table = self.catalog[name]
        names = table_dims(table, self._stream(table).df.columns, self._stream(table).ts, self._stream(table).vals)
        by = list(table.partition_by) or names
        out = self.rollup(name).withColumn("_day", F.to_date(TIME))
        out = out.repartition(*map(F.col, ["_day", *by])).sortWithinPartitions(*names, TIME)
        out.write.mode("overwrite").partitionBy("_day").parquet(path)
        self.clock(name)
        self.stored[name.lower()] = lambda fresh: self.spark.read.parquet(path).drop("_day")

    def _source_of(self, name: str, q: Query) -> Source:
        table = self.catalog[name]
        if table.virtual:
            raise QueryError(f"table {name} is virtual and can't be queried")
        now = self.clock(name)
        until = ceil_us(now, table.resolution)
        as_of = ceil_us(until - table.retention, table.resolution)
        within, rewrite = None, self._rewrites.get(name.lower(), lambda df: df)
        if name.lower() in self.stored:
            df = rewrite(self.stored[name.lower()](q.fresh or self._fresh))
        else:  # the query's own aggregation merges the states of points: one shuffle, not two
            s = self._stream(table)

            def within(span: tuple[int, int] | None) -> DataFrame:
                return rewrite(rollup(s.df, table, self.dims, s.ts, s.vals, now, self.array_tail_copies, False, span))

            df = within(None)
        states = {c for s in table.slots.values() for c in s.columns}
        dims = [c for c in df.columns if c != TIME and c not in states]
        return Source(df, dims, table.resolution, as_of, until, table.fields, table.slots, now, within)

    _fresh = False

    # Queries.

    def plan(self, sql: str, gap_fill: bool | str = "auto", crosstab_values: list[str] | None = None, fresh: bool = False) -> Planned:
        self._fresh = fresh
        return Planner(self.dims, self._source_of, gap_fill, crosstab_values).plan(parse_query(sql))

    def query(self, sql: str, **options: object) -> DataFrame:
        """``_time``, dimensions by name, fields in order; nothing runs before an action but a crosstab's values and virtual time."""
        max_age = options.pop("max_age", None)
        planned = self.plan(sql, **options)  # type: ignore[arg-type]
        if max_age is not None and time.time() * 1e6 - planned.until > parse_duration(str(max_age)):
            raise QueryError("the data is older than max_age")
        return planned.df

    def explain(self, sql: str, **options: object) -> str:
        return "\n".join(self.plan(sql, **options).steps)  # type: ignore[arg-type]

    def cached(self, sql: str) -> DataFrame:
        """A query's result, kept in memory for a while."""
        now = time.monotonic()
        for k in [k for k, (at, _) in self._cache.items() if now - at > self.cache_ttl]:
            self._cache.pop(k)[1].unpersist()
        if sql not in self._cache:
            self._cache[sql] = now, self.query(sql).cache()
        return self._cache[sql][1]

    def collect(self, sql: str, timeout: float | None = None, **options: object) -> list[Row]:
        """A query's rows, or an error once ``timeout`` seconds have gone; its jobs are stopped then."""
        return self.within(timeout, sql, lambda: self.query(sql, **options).collect())

    def within(self, timeout: float | None, what: str, run: Callable[[], T]) -> T:
        """``run()``, whose jobs are stopped once ``timeout`` seconds have gone."""
        context, group, fired = self.spark.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            fired.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout, stop) if timeout is not None else None
        context.setJobGroup(group, what, interruptOnCancel=True)
        try:
            if timer:
                timer.start()
            return run()
        except Exception as e:
            if fired.is_set():
                raise QueryError(f"the query took more than {timeout:g} seconds") from e
            raise
        finally:
            if timer:
                timer.cancel()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)

    def keep(self, sql: str, folder: str, **options: object) -> str:
        """Write a query's result under a permanent name, which outlives this session; the name."""
        name = uuid.uuid4().hex
        self.query(sql, **options).write.parquet(f"{folder.rstrip('/')}/{name}")
        return name

    def kept(self, name: str, folder: str) -> DataFrame:
        """A result by the name that ``keep`` gave it."""
        if not re.fullmatch("[0-9a-f]{32}", name):
            raise QueryError(f"{name!r} is no name of a result")
        return self.spark.read.parquet(f"{folder.rstrip('/')}/{name}")

    def cardinalities(self, sql: str, exact: bool = False) -> DataFrame:
        """The number of values of every column of a result, in one pass."""
        df = self.query(sql)
        count: Callable[[str], Column] = F.countDistinct if exact else F.approx_count_distinct
        return df.agg(*(count(f"`{c}`").alias(c) for c in df.columns))

    def stats(self, name: str) -> dict[str, int]:
        """Points of the stream that a table filters out, takes in, and finds expired."""
        table = self.catalog[name]
        s = self._stream(table)
        passes = F.coalesce(self.dims.column(table.where, s.df.schema), F.lit(False)) if table.where is not None else F.lit(True)
        fresh = F.col(s.ts) >= from_micros(F.lit(self.clock(name) - table.retention))
        df = spread_arrays(s.df.withColumn("__pass", passes).withColumn("__fresh", fresh), s.vals, self.array_tail_copies)
        n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
        row = df.agg(n(~F.col("__pass")).alias("filtered"), n(F.col("__pass") & F.col("__fresh")).alias("inserted"), n(F.col("__pass") & ~F.col("__fresh")).alias("expired")).first()
        return row.asDict()

    def merged(self, name: str, *parts: DataFrame) -> DataFrame:
        """Partial rollups of a table as one."""
        table = self.catalog[name]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        states = {c for s in table.slots.values() for c in s.columns}
        return merge(whole, table, [c for c in whole.columns if c != TIME and c not in states])
