"""What the operators of this subpackage share: the shared folder and small checks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master, where all run on one machine, is a folder made if the session
    names none; it is set on the context so that later calls agree. Elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronoroll-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Folders of tables that results of this session may still read.
_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables; for when no result of the operators is read any more."""
    while _roots:
        remove(spark, _roots.pop())


class Stash:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes and rereads a table, so that a lost executor costs a task
    and never the stages before it; ``drop`` deletes one that nothing
    lazy depends on any more, and ``clear`` what is left when results have been read.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0
        #: By identity, with the tables themselves: else the identity of one that is forgotten could become another's.
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        _roots.append(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.paths.pop(id(df), (None, None))
            if path:
                remove(self.spark, path)


#: Keys of more than one row in so many are hot.
SPREAD = 5000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Inner join of ``left``, of ``rows`` rows, with ``right``, which has each key once and in ``c`` how many rows of ``left`` have it.

    A hot key's rows go to as many tasks as one row in ``SPREAD`` makes parts of them, with a copy of its one row of
    ``right`` each. Hot keys are at most ``SPREAD``, as their rows would else be more than all, so ``left`` learns of them by
    broadcast. ``right`` is read twice, so it should be a table.
    """
    parts = F.when(F.col("c") * SPREAD > F.lit(rows), F.ceil(F.col("c") * SPREAD / F.lit(max(1, rows)))).cast("int")
    hot = right.where(F.col("c") * SPREAD > F.lit(rows)).select(*on, parts.alias("__parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__parts")).cast("int"), F.lit(0))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__parts")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    return dealt.join(copies, [*on, "__salt"]).drop("__salt")


def by_row(df: DataFrame, id_col: str, text_col: str, stash: Stash) -> tuple[DataFrame, bool]:
    """``row``, ``id``, ``text`` and ``whole``: a key of each row in the order of ids, null ids last, and the row itself; and whether the key is the id.

    It is where ids are whole numbers, none is null and none is there twice; else the rows
    are sorted, those of one id by their texts, numbered and written. A row is then a document, whatever its id.
    """
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole"))
    id_, text = F.col(f"whole.`{id_col}`"), F.col(f"whole.`{text_col}`")
    named = lambda rows, key: rows.select(key.alias("row"), id_.alias("id"), text.alias("text"), "whole")
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        odd = docs.groupBy(id_.alias("id")).agg(F.count(F.lit(1)).alias("c")).where("id IS NULL OR c > 1")
        if odd.isEmpty():
            return named(docs, id_.cast("long")), True
    by = [id_.isNull(), id_, F.xxhash64(text), F.monotonically_increasing_id()]
    return named(stash.put(docs.orderBy(*by).withColumn("row", F.monotonically_increasing_id())), F.col("row")), False


def settle(spark: SparkSession) -> None:
    """Let go of shuffles that nothing uses any more; else they lie on disk until the driver collects garbage.

    Only disk depends on it: results are the same without.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it from; once per context."""
    context = spark.sparkContext
    if getattr(context, "_chronoroll_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "chronoroll.zip"  # the driver serves it to executors
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    context._chronoroll_shipped = True


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
