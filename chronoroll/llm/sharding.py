"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is
its rank within its source, less a phase of the source's own between 0 and 1, over the source's size. Sources of equal size have
phases at equal distances, in a shuffled order. So, sorted by fractional rank, every source is spread evenly over the whole order, and
sources of a row or two, which can't be in every shard, are together. The order is cut into shards whose sizes differ by one row at
most; so every shard has the mixture of the whole.

Ranks are never counted in one task per source: the leading bits of the hash deal each source to small buckets,
the counts of the buckets are summed before, and a row's rank is its number in its
bucket plus that sum. Sources of one size are ranked in the same way, and so is the order by fractional rank.

Defined results: a null source is a source of its own; a null text has no bytes; rows
with equal ids or texts are dealt each by itself, null ids like any other; texts of any length cost their bytes and a
checksum only; an empty table gives an empty table; columns other than the id, the text and the source are not
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, documents

SHARDS, SEED = 24, 17
#: Rows of a bucket, about, and the fewest and most bits that buckets are told apart by.
BUCKET, FEWEST, MOST = 2000, 6, 16
#: Bits of a hash.
BITS = 60


def hashed(*parts: Column) -> Column:
    """A number of 60 bits; nulls are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, BITS // 4), 16, 10).cast("long")


def _before(counts: DataFrame, order: str, *by: str) -> DataFrame:
    """Sums of ``n`` over the buckets before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def interleave(spark: SparkSession, df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard``, ``slot``."""
    stash = Stash(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash.put(df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed(F.lit(seed), F.col(id_col)).alias("at"),
    ))
    total = rows.count()
    bits = min(MOST, max(FEWEST, (total // BUCKET).bit_length()))
    rows = rows.withColumn("bucket", F.shiftright("at", BITS - bits))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sources = stash.put(counts.groupBy("source").agg(F.sum("n").alias("all")).withColumn("at", hashed(F.lit(seed), F.col("source"))).withColumn("part", F.shiftright("at", BITS - bits)))
    alike = sources.groupBy("all", "part").agg(F.count(F.lit(1)).alias("n"))
    several = _before(alike, "part", "all").join(alike.groupBy("all").agg(F.sum("n").alias("of")), "all").select("all", "part", F.col("before").alias("ahead"), "of")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("all", "part").orderBy("at", "source"))
    phases = sources.join(several, ["all", "part"]).select("source", "all", ((place - 0.5) / F.col("of")).alias("phase"))
    base = _before(counts, "bucket", "source").join(phases, "source").select("source", "bucket", "before", "all", "phase")
    own = Window.partitionBy("source", "bucket").orderBy("at", "id", "text_crc32", "size")
    ranked = rows.withColumn("k", F.row_number().over(own)).join(base, ["source", "bucket"])
    share = (F.col("before") + F.col("k") - F.col("phase")) / F.col("all")
    ranked = stash.put(ranked.select("id", "source", "size", "text_crc32", share.alias("share"), F.floor(share * (1 << bits)).alias("slice")))
    slices = _before(ranked.groupBy("slice").agg(F.count(F.lit(1)).alias("n")), "slice").select("slice", "before")
    order = Window.partitionBy("slice").orderBy("share", "source")
    placed = ranked.withColumn("k", F.row_number().over(order)).join(slices, "slice").withColumn("place", F.col("before") + F.col("k") - 1)
    cut = placed.withColumn("shard", F.expr(f"cast((place * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return cut.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - first).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(spark, documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
