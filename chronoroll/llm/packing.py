"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

Documents are tokenized where they lie and cut into pieces of at most ``capacity``
tokens. Only the histogram of piece lengths (``capacity`` rows at most) goes to the
driver. There, best fit in falling order of length runs over counts: a step takes all
open sequences of one free space at once, so a plan has some ten thousand rows
however many documents there are. A row says: pieces of this length with ranks in
this range take, one each, the place at this offset in this range of sequences.

A piece's rank within its length is its running number in its own partition plus the
counts of the partitions before, so no length, however frequent, meets in one task.

Defined results: a null or empty text is one piece, the end token alone; rows with
equal ids or texts are packed each by itself; an empty table gives an empty table;
columns other than the id and the text are not carried along.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, documents, map_batches
from .word_tokens import default_vocabulary, word_codec

CAPACITY, END, ROWS = 4096, 1, 1000


def pieces(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with the partition and the running number of its length there."""
    path = vocabulary or default_vocabulary()
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids_crc32 long, part int, place long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = word_codec(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                owner, rows = [], []
                for at, ids in enumerate(codec.encode(batch.column(1).to_pylist())):
                    ids += END.to_bytes(4, "little")
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[start : start + 4 * capacity]
                        length = len(one) // 4
                        owner.append(at)
                        rows.append((n, start // 4, length, zlib.crc32(one), part, seen[length], one)[: 6 + with_ids])
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *map(pa.array, zip(*rows), [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])], [c.split()[0] for c in schema.split(", ")])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit in falling order of length over counts.

    Rows of (length, first rank, number, first sequence, offset). Sequences with equal
    free space are kept as ranges; each takes as many pieces of a length as
    fit before the next one gets any, which is what best fit does piece by piece.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    new = 0

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if not open_.get(space):
                insort(spaces, space)
            open_.setdefault(space, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    spaces.pop(at)
            else:
                space, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            fit = space // length
            used = min(n, left // fit)
            each = fit if used else left
            used = max(used, 1)
            for k in range(each):
                rows.append((length, rank + k * used, used, first, capacity - space + k * length))
            leave(space - each * length, first, used)
            leave(space, first + used, n - used)
            rank, left = rank + each * used, left - each * used
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(spark: SparkSession, df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    stash = Stash(spark, "packing")
    cut = stash.put(pieces(df, vocabulary, capacity, with_ids, id_col, text_col))
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)
    keys, free = (slots[:, 0] << 44) | slots[:, 1], slots
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda name: b.column(b.schema.get_field_index(name))
            rank = col("place").to_numpy() + col("base").to_numpy()
            row = free[np.searchsorted(keys, (col("length").to_numpy().astype(np.int64) << 44) | rank, "right") - 1] if b.num_rows else free[:0]
            out = [col("id"), col("piece"), col("start"), col("length").cast(pa.int64()), col("ids_crc32"), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            yield pa.RecordBatch.from_arrays(out + [col("ids")] * with_ids, names)

    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    kind = cut.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return map_batches(ranked, take, schema).withColumnRenamed("id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
