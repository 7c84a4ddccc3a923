"""Points from Python and from JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string of JSON, and an object that holds objects, which hold no more.
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_PLAIN = r'[^{}"]++|' + _STRING
OBJECT = r"\{(?:" + _PLAIN + r"|\{(?:" + _PLAIN + r")*+\})*+\}"


def from_tuples(spark: SparkSession, points: Iterable[tuple[object, dict, dict]]) -> tuple[DataFrame, list[str]]:
    """A DataFrame of (ts, dims, vals) and the names of its values; values of other kinds than numbers and lists of them are left out."""
    rows, kinds, vals = [], {}, {}
    for ts, dims, values in points:
        row: dict[str, object] = {"ts": ts}
        for k, v in dims.items():
            kinds[k.lower()] = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
            row[k.lower()] = v
        for k, v in values.items():
            if isinstance(v, list | tuple):
                vals[k.lower()] = T.ArrayType(T.DoubleType())
                row[k.lower()] = [float(x) for x in v]
            elif isinstance(v, int | float) and not isinstance(v, bool):
                vals.setdefault(k.lower(), T.DoubleType())
                row[k.lower()] = float(v)
        rows.append(row)
    for row in rows:
        for k, kind in vals.items():
            if isinstance(kind, T.ArrayType) and isinstance(row.get(k), float):
                row[k] = [row[k]]
    names = ["ts", *kinds, *vals]
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType()), *(T.StructField(k, v) for k, v in (kinds | vals).items())])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), list(vals)


def read_json(spark: SparkSession, path: str, dims: dict[str, str], vals: Iterable[str], now: str | None = None, streaming: bool = False, clean: str | None = None, archive: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects {"ts", "dims", "vals"}, one or more a line: accepted points as columns, and what was rejected with a reason.

    ``dims``: Spark types by name. A point without ts gets ``now`` (or the current time);
    one without any dimension or any value is rejected. ``clean``: what becomes of a stream's files once they
    are taken in, ``delete`` or ``archive`` (to the folder ``archive``).
    """
    vals = list(vals)
    schema = T.StructType([
        T.StructField("ts", T.StringType()),
        T.StructField("dims", T.MapType(T.StringType(), T.StringType())),
        T.StructField("vals", T.MapType(T.StringType(), T.StringType())),
    ])
    reader = spark.readStream if streaming else spark.read
    if streaming and clean:
        reader = reader.option("cleanSource", clean)
        reader = reader.option("sourceArchiveDir", archive) if archive else reader
    lines = reader.text(path).where(F.length(F.trim("value")) > 0)
    # Objects that follow each other on a line; what is left between them is rejected by itself.
    found, left = F.regexp_extract_all("value", F.lit(OBJECT), F.lit(0)), F.trim(F.regexp_replace("value", OBJECT, " "))
    objects = F.concat(found, F.when(F.length(left) > 0, F.array(left)).otherwise(F.slice(found, 1, 0)))
    parsed = lines.select(F.explode(objects).alias("value")).select("value", F.from_json("value", schema).alias("p"))
    reason = (
        F.when(F.col("p").isNull() | (F.col("p.dims").isNull() & F.col("p.vals").isNull() & F.col("p.ts").isNull()), "not a point")
        .when(F.coalesce(F.size("p.dims"), F.lit(0)) < 1, "no dimensions")
        .when(F.coalesce(F.size("p.vals"), F.lit(0)) < 1, "no values")
        .when(F.col("p.ts").isNotNull() & F.col("p.ts").try_cast("timestamp").isNull(), "invalid ts")
    )
    parsed = parsed.withColumn("reason", reason)
    ts = F.coalesce(F.col("p.ts").try_cast("timestamp"), F.lit(now).cast("timestamp") if now else F.current_timestamp()).cast("timestamp_ntz")
    number = lambda v: F.try_element_at("p.vals", F.lit(v))
    good = parsed.where("reason IS NULL").select(
        ts.alias("ts"),
        *(F.try_element_at("p.dims", F.lit(d)).try_cast(kind).alias(d.lower()) for d, kind in dims.items()),
        *(F.when(number(v).startswith("["), F.from_json(number(v), "array<double>")).when(number(v).isNotNull(), F.array(number(v).try_cast("double"))).alias(v.lower()) for v in vals),
    )
    return good, parsed.where("reason IS NOT NULL").select("value", "reason")


def report(good: DataFrame, bad: DataFrame) -> dict:
    """How many points were taken and rejected, and why."""
    errors = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    return {"succeeded": good.count(), "failed": sum(errors.values()), "errors": errors}
