"""Tables that follow a stream: partial rollups per micro-batch, compacted by and by.

A batch's partial states go to a folder named by the batch's number and overwrite it, so a
batch that is delivered again changes nothing. Its mark, a small file beside it, says how far the batch's clock got. Compaction merges partials into a
new base, drops what has expired, and then adds a numbered pointer to it. No file is ever written in place: marks and pointers are
written aside and renamed, batches write only their own mark and compaction only pointers, so a crash between two
steps leaves the table as it was before, and the two may run at the same time. Reading takes the base alone,
or with the partials that came since.
"""

from __future__ import annotations

import json
import logging
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..functions.timegrid import from_micros, micros
from ..operators.rollup import TIME, rollup

log = logging.getLogger(__name__)

#: Pointers and their bases that are kept for readers that are still at them.
KEPT = 2


class ContinuousTable:
    """``compact_after``: batches after which partials are compacted, so that a query never unites more; None leaves it to ``compact``.

    ``compact_every``: seconds after which they are compacted though they are fewer, with the next batch.
    """

    def __init__(self, engine: Engine, name: str, path: str, ts: str = "ts", vals: tuple[str, ...] = ("value",), compact_after: int | None = 32, compact_every: float | None = None) -> None:
        self.engine, self.name, self.path = engine, name, path.rstrip("/")
        self.ts, self.vals = ts, list(vals)
        self.compact_after, self.compact_every = compact_after, compact_every
        self._compacted = time.monotonic()
        engine.stored[name.lower()] = self.read
        jvm = engine.spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration())
        self._jpath = jvm.org.apache.hadoop.fs.Path

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, every: str | None = None) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=available_now)).start()

    def take(self, batch: DataFrame, number: int) -> None:
        """Late points are taken into their own period while within the retention period of the latest.

        Only points that pass the table's WHERE move its clock.
        """
        table, state = self.engine.catalog[self.name], self.state()
        if number <= state["upto"]:
            return  # delivered again after it was compacted
        batch = batch.persist()  # read by the clock and by the rollup
        passing = batch
        if table.where is not None:
            passing = batch.where(F.coalesce(self.engine.dims.column(table.where, batch.schema), F.lit(False)))
        own = passing.agg(F.max(self.ts).alias("at")).select(micros(F.col("at"))).first()[0]
        latest = max([x for x in (own, state["latest"]) if x is not None], default=None)
        part = rollup(batch, table, self.engine.dims, self.ts, self.vals, latest)
        part.write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        self._write(f"mark/{number}", {"latest": own})
        batch.unpersist()
        self.engine._times.pop(self.name.lower(), None)
        waiting = len(self._deltas(state["upto"]))
        late = self.compact_every is not None and time.monotonic() - self._compacted >= self.compact_every
        if waiting and (late or (self.compact_after is not None and waiting >= self.compact_after)):
            self.compact()

    # Small files.

    def _list(self, folder: str) -> list[str]:
        where = self._jpath(f"{self.path}/{folder}")
        return [s.getPath().toString() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _numbered(self, folder: str) -> dict[int, str]:
        names = {p: p.rpartition("/")[2].removesuffix(".json") for p in self._list(folder)}
        return {int(n): p for p, n in names.items() if n.isdigit()}

    def _write(self, name: str, value: dict) -> None:
        """Aside, then renamed: a reader sees all of it or nothing."""
        to, aside = self._jpath(f"{self.path}/{name}.json"), self._jpath(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(aside, to):
            self._fs.delete(to, False)
            if not self._fs.rename(aside, to):
                raise OSError(f"can't write {to}")

    def _load(self, path: str) -> dict | None:
        try:
            stream = self._fs.open(self._jpath(path))
            try:
                return json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
        except (ValueError, Py4JJavaError):
            return None

    def state(self) -> dict:
        """The newest pointer that can be read, with the latest point of it and of the batches since."""
        found = {"base": None, "upto": -1, "latest": None}
        for _, path in sorted(self._numbered("pointer").items(), reverse=True):
            if (own := self._load(path)) is not None:
                found = own
                break
            log.warning("%s can't be read; the pointer before it is taken", path)
        marks = [self._load(p) or {} for n, p in self._numbered("mark").items() if n > found["upto"]]
        times = [m["latest"] for m in (found, *marks) if m.get("latest") is not None]
        return found | {"latest": max(times, default=None)}

    def _deltas(self, after: int) -> list[tuple[int, str]]:
        """Batches that were written to their end."""
        marks = self._numbered("mark")
        numbered = ((int(p.rpartition("=")[2]), p) for p in self._list("delta") if "batch=" in p)
        return sorted(x for x in numbered if x[0] > after and x[0] in marks)

    # Reading.

    def read(self, fresh: bool = True) -> DataFrame:
        """The compacted states, with those of later batches if ``fresh`` or if nothing is compacted yet."""
        s = self.state()
        parts = [self.engine.spark.read.parquet(s["base"])] if s["base"] else []
        if fresh or not parts:
            new = [p for _, p in self._deltas(s["upto"])]
            if new:  # one scan, however many batches there are
                parts.append(self.engine.spark.read.option("mergeSchema", True).parquet(*new))
        if not parts:
            raise ValueError(f"table {self.name} has taken in nothing yet")
        if len(parts) == 1 and s["base"]:
            return parts[0]
        return self.engine.merged(self.name, *parts)

    def info(self) -> dict:
        """What is stored: rows compacted and not, columns, and the latest timestamps of either (microseconds)."""
        s = self.state()
        new = [self.engine.spark.read.parquet(p) for _, p in self._deltas(s["upto"])]
        base = self.engine.spark.read.parquet(s["base"]) if s["base"] else None
        mark = lambda df: df.agg(F.max(micros(F.col(TIME)))).first()[0]
        return {
            "columns": (base or new[0]).columns if base or new else [],
            "base_rows": base.count() if base else 0,
            "delta_rows": sum(df.count() for df in new),
            "base_mark": mark(base) if base else None,
            "delta_mark": max((m for m in map(mark, new) if m is not None), default=None),
            "latest_point": s["latest"],
        }

    def check(self, quarantine: bool = False) -> list[str]:
        """Folders of states that can't be read to their end; moved to ``quarantine`` if asked, so that the rest can be queried.

        A base that is moved is replaced by the one before it, if that is still kept.
        """
        s = self.state()
        bad = []
        for path in ([s["base"]] if s["base"] else []) + [p for _, p in self._deltas(s["upto"])]:
            try:
                self.engine.spark.read.parquet(path).write.format("noop").mode("overwrite").save()
            except (PySparkException, Py4JJavaError):
                bad.append(path)
        for path in bad if quarantine else ():
            self._fs.mkdirs(self._jpath(f"{self.path}/quarantine"))
            self._fs.rename(self._jpath(path), self._jpath(f"{self.path}/quarantine/{path.rpartition('/')[2]}-{uuid.uuid4().hex[:8]}"))
            log.warning("%s is damaged and was moved to quarantine", path)
            if path == s["base"]:
                pointers = self._numbered("pointer")
                before = next((own for n in sorted(pointers, reverse=True) if (own := self._load(pointers[n])) and own["base"] != path and self._fs.exists(self._jpath(own["base"]))), None)
                self._write(f"pointer/{max(pointers) + 1}", {"base": before and before["base"], "upto": s["upto"], "latest": s["latest"]})
        self.engine._times.pop(self.name.lower(), None)
        return bad

    # Compaction.

    def compact(self) -> None:
        """Merge partials into a new base; what was there stays until the new pointer is."""
        s = self.state()
        new = self._deltas(s["upto"])
        self._compacted = time.monotonic()
        if not new:
            return
        table = self.engine.catalog[self.name]
        parts = [self.engine.spark.read.parquet(s["base"])] if s["base"] else []
        df = self.engine.merged(self.name, *parts, self.engine.spark.read.option("mergeSchema", True).parquet(*(p for _, p in new)))
        if s["latest"] is not None:
            df = df.where(F.col(TIME) >= from_micros(F.lit(s["latest"] - table.retention)))
        upto = new[-1][0]
        base = f"{self.path}/base/{upto}-{uuid.uuid4().hex[:8]}"
        df.sortWithinPartitions(TIME).write.parquet(base)
        pointers = self._numbered("pointer")
        self._write(f"pointer/{max(pointers, default=0) + 1}", {"base": base, "upto": upto, "latest": s["latest"]})
        for n, p in self._deltas(-1):
            if n <= upto:
                self._fs.delete(self._jpath(p), True)
        for n, p in self._numbered("mark").items():
            if n <= upto:
                self._fs.delete(self._jpath(p), False)
        pointers = self._numbered("pointer")
        old = sorted(pointers)[:-KEPT]
        used = {own["base"] for n in sorted(pointers)[-KEPT:] if (own := self._load(pointers[n]))}
        for n in old:
            own = self._load(pointers[n])
            if own and own["base"] and own["base"] not in used:
                self._fs.delete(self._jpath(own["base"]), True)
            self._fs.delete(self._jpath(pointers[n]), False)
