"""Suffix-array dedup: remove bytes of long strings that also start earlier.

Every string of ``length`` bytes holds an *anchor*: the ``GRAM`` bytes of least hash in it, the
leftmost among equals. Equal strings have equal anchors at equal places, so strings
are compared only where an anchor is found twice. A run of strings with one anchor is a
segment. Equal segments are collapsed to the earliest; the distinct segments of an anchor
meet in one block. There a suffix array and its Burrows-Wheeler transform are built, and
intervals are extended backwards, breadth first: level l finds all common
prefixes of l bytes, and each value is written once. The expansion stops at ``length``: suffixes
whose value is still open by then share at least so many bytes. The earliest of each such class
stays, all others are marked.

A passage in a million surroundings has as many segments at its ends. An anchor of more than ``HOT`` segments is split
before any block is made, exactly: strings are told apart by where the anchor stands in them, ``WIDTHS[0]`` neighbouring
places together, and by the *core* that all strings of these places share, which equal strings have in common. Equal pieces
collapse, and what is still hot is split by narrower ranges of places; at one place the core is the whole string.
So no block holds more than ``HOT`` segments of an anchor.

Two things are decided by hashes, not by the transform: a text that is a copy (MD5) of an earlier document's goes as a whole if
it has a string of that length, and segments of one anchor with equal 64-bit hashes are equal.

Defined results: a null or empty text has no bytes and loses none; each row is a document, also where ids are null, repeat or are no
numbers; smaller ids are earlier, null ids come last, and among rows of one id the order is that of a hash of the text, so one
of equal rows stays; texts of any length are read whole; an empty table gives an empty table; columns
other than the id and the text are not carried along, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, by_row, documents, map_batches, settle, spread_join
from .shingle_join import _mix

LENGTH, GRAM = 100, 32
#: A block is closed at the next anchor beyond this many bytes.
BLOCK = 250_000
#: An anchor of more segments is split, by ranges of so many places.
HOT, WIDTHS = 1500, (16, 4, 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from every place on, along the last axis."""
    with np.errstate(over="ignore"):
        h, k = _mix(raw.astype(np.uint64) + np.uint64(1)), 1
        for odd in _ODD:
            h = h[..., :-k] * odd + h[..., k:]
            k *= 2
        return _mix(h)


def anchor_runs(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes with the first string and the number of strings of each run."""
    if len(raw) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(raw)
    key = (h >> np.uint64(33) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, k = length - GRAM + 1, 1
    while 2 * k <= width:
        key, k = np.minimum(key[:-k], key[k:]), 2 * k
    if k < width:
        key = np.minimum(key[: k - width], key[width - k :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return h[at[first]], first, np.diff(np.append(first, len(at)))


def occurrences(df: DataFrame, length: int) -> DataFrame:
    """anchor, segment hash, doc, start and number of strings; of the copies in a task, the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: dict[int, int] = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                b = whole.slice(k, 200)
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = (text or "").encode()
                    if len(raw) < length or seen.get(p := xxhash.xxh3_64_intdigest(raw), doc + 1) <= doc:
                        continue
                    seen[p] = doc
                    anchors, starts, n = anchor_runs(np.frombuffer(raw, np.uint8), length)
                    hashes = np.array([xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), (starts + n + length - 1).tolist())], np.uint64)
                    for col, x in zip(out, (anchors.view(np.int64), hashes.view(np.int64), np.full(len(n), doc, np.int64), starts, n)):
                        col.append(x)
                cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], ["anchor", "segment", "doc", "start", "n"])

    return map_batches(df, run, "anchor long, segment long, doc long, start int, n int")


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their first ``depth`` symbols or more, and the inverse."""
    k = 7  # symbols of nine bits that a number holds
    wide = np.append(text, np.zeros(k, np.int64))
    key = np.zeros(len(text), np.int64)
    for j in range(k):
        key = (key << 9) | wide[j : j + len(text)]
    rank = np.empty(len(text), np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank[order] = new
        if k >= depth or new[-1] == len(rank) - 1 or k >= len(rank):
            break
        next_ = np.zeros(len(rank), np.int64)
        next_[:-k] = rank[k:] + 1
        key = rank * (len(rank) + 2) + next_
        k *= 2
    inverse = np.empty(len(rank), np.int64)
    inverse[order] = np.arange(len(rank))
    return order, inverse


def common_prefixes(text: np.ndarray, order: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
    """Of neighbours in the suffix array, the common prefix if it is shorter than ``length``, else -1.

    Breadth-first backward extension: at level l the intervals of all strings of l + 1
    symbols that are still open are known. Where the entry behind an interval is open, it is
    l, and only then is the interval extended by each symbol that stands before it in the transform.
    Symbol 0 parts the segments and is never extended by.
    """
    n = len(text)
    before = order - 1
    bwt = np.where(before >= 0, text[before], 0)
    back = np.where(before >= 0, inverse[before], 0)
    found = np.full(n + 1, -1, np.int64)
    lead = text[order]
    low = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
    high = np.append(low[1:], n)
    for level in range(length):
        open_ = (found[high] < 0) & (high < n)
        found[high[open_]] = level
        # The last interval of all has no entry behind it; it is extended as long as it is one.
        keep = open_ | (high == n)
        low, high = low[keep], high[keep]
        if not len(low) or level == length - 1:
            break
        sizes = high - low
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        owner = np.repeat(np.arange(len(low)), sizes)
        real = bwt[places] > 0
        to, owner = back[places[real]], owner[real]
        if not len(to):
            break
        by = np.argsort(to, kind="stable")
        to, owner = to[by], owner[by]
        new = np.append(True, (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (lead[to[1:]] != lead[to[:-1]]))
        at = np.flatnonzero(new)
        low, high = to[at], to[np.append(at[1:], len(to)) - 1] + 1
    return found[:n]


def later_strings(segments: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc, start, number) of runs of strings in (doc, start, bytes) that are equal to an earlier one."""
    sizes = np.array([len(s[2]) for s in segments])
    text = np.zeros(int(sizes.sum()) + len(segments), np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    flat = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
    inside = np.ones(len(text), bool)
    inside[first + sizes] = False
    text[inside] = flat.astype(np.int64) + 1
    which = np.repeat(np.arange(len(segments)), sizes + 1)
    start = np.arange(len(text)) - first[which]
    whole = start <= sizes[which] - length
    doc = np.array([s[0] for s in segments], np.int64)[which]
    start = start + np.array([s[1] for s in segments], np.int64)[which]
    order, inverse = suffix_array(text, length)
    common = common_prefixes(text, order, inverse, length)
    heads = np.flatnonzero((common >= 0) | ~whole[order] | (np.arange(len(order)) == 0))
    rank = np.empty(len(text), np.int64)
    rank[np.lexsort((start, doc))] = np.arange(len(text))
    least = np.repeat(np.minimum.reduceat(rank[order], heads), np.diff(np.append(heads, len(order))))
    later = order[(rank[order] != least) & whole[order]]
    # One string may lie in two segments of a block only as the same place: those are equal, not later.
    one = np.empty(len(text), np.int64)
    one[rank] = np.arange(len(text))
    origin = one[least[inverse[later]]]
    later = later[(doc[later] != doc[origin]) | (start[later] != start[origin])]
    if not len(later):
        return []
    by = later[np.lexsort((start[later], doc[later]))]
    cut = np.flatnonzero(np.append(True, (doc[by[1:]] != doc[by[:-1]]) | (start[by[1:]] != start[by[:-1]] + 1)))
    return list(zip(doc[by[cut]].tolist(), start[by[cut]].tolist(), np.diff(np.append(cut, len(by))).tolist()))


def split_segments(df: DataFrame, width: int, length: int) -> DataFrame:
    """Segments cut where the anchor's place in their strings passes a multiple of ``width``.

    ``df``: doc, start, place (of the anchor in the first string, null if not known yet) and bytes. Puts out key, which pieces with equal strings
    share, segment (the piece's hash), doc, start, n, place and bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            raws, places = b.column("bytes").to_pylist(), b.column("place").to_pylist()
            if raws and places[0] is None:
                first = np.frombuffer(b"".join(r[:length] for r in raws), np.uint8).reshape(-1, length)
                places = (gram_hashes(first) >> np.uint64(33)).argmin(1).tolist()
            rows = []
            for doc, start, place, raw in zip(b.column("doc").to_pylist(), b.column("start").to_pylist(), places, raws):
                k, n = 0, len(raw) - length + 1
                while k < n:
                    at = (place - k) // width
                    end = min(n, place - at * width + 1)  # strings k to end have the anchor in this range of places
                    core = raw[place - at * width : place - (at + 1) * width + 1 + length]
                    piece = raw[k : end + length - 1]
                    rows.append((xxhash.xxh3_64_intdigest(core, at), xxhash.xxh3_64_intdigest(piece), doc, start + k, end - k, place - k, piece))
                    k = end
            key, segment, *rest = list(zip(*rows)) or [()] * 7
            hashes = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, segment))
            yield pa.RecordBatch.from_arrays([*hashes, *map(pa.array, rest, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["key", "segment", "doc", "start", "n", "place", "bytes"])

    return map_batches(df.select("doc", "start", "place", "bytes"), run, "key long, segment long, doc long, start int, n int, place int, bytes binary")


def in_blocks(segments: DataFrame, length: int) -> DataFrame:
    """doc, start, n of strings equal to an earlier one of the same key. ``segments``: key, doc, start, bytes."""
    n = max(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = segments.select("key", "doc", "start", "bytes").repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        size, at = 0, None

        def out() -> pa.RecordBatch:
            cols = list(zip(*later_strings(block, length))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()))], ["doc", "start", "n"])

        for b in batches:
            for key, doc, start, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                if key != at and size > BLOCK:
                    yield out()
                    block, size = [], 0
                at = key
                block.append((doc, start, raw))
                size += len(raw)
        if block:
            yield out()

    return map_batches(met, run, "doc long, start int, n int")


def split_hot(hot: DataFrame, stash: Stash, length: int) -> list[DataFrame]:
    """As ``in_blocks``, of segments whose anchors have too many for a block."""
    place, found = F.struct("doc", "start"), []
    hot = hot.withColumn("place", F.lit(None).cast("int"))
    for width in WIDTHS:
        pieces = stash.put(split_segments(hot, width, length))
        firsts = pieces.groupBy("key", "segment").agg(F.min(place).alias("e"), F.count(F.lit(1)).alias("c"))
        firsts = stash.put(firsts.select("key", "segment", "e", "c"))
        again = spread_join(pieces.select("key", "segment", "doc", "start", "n"), firsts.where("c > 1"), ["key", "segment"], pieces.count())
        found.append(stash.put(again.where(place != F.col("e")).select("doc", "start", "n")))
        several = stash.put(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        own = firsts.select("key", "segment", "e.doc", "e.start")  # a place has one row, so no key of this join is hot
        single = stash.put(pieces.join(own, ["key", "segment", "doc", "start"]))
        left = stash.put(spread_join(single, several, ["key"], single.count()))
        found.append(stash.put(in_blocks(left.where(F.col("c") <= HOT), length)))
        stash.drop(pieces, firsts, several, single)
        hot = left.where(F.col("c") > HOT).drop("c")
        if hot.isEmpty():
            return found
    raise RuntimeError("strings of one core differ")  # can't be: at width 1 the core is the string


def repeats(df: DataFrame, stash: Stash, length: int = LENGTH) -> DataFrame:
    """doc, start, n: runs of strings that are equal to an earlier one. ``df``: doc, text; ids are unique."""
    spark = df.sparkSession
    place = F.struct("doc", "start")
    all_ = stash.put(occurrences(df, length))
    twice = stash.put(all_.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    found = stash.put(spread_join(all_, twice, ["anchor"], all_.count()).drop("c"))
    stash.drop(all_, twice)
    settle(spark)
    earliest = found.groupBy("anchor", "segment").agg(F.min(F.struct("doc", "start", "n")).alias("e"), F.count(F.lit(1)).alias("c"))
    earliest = stash.put(earliest.select("anchor", "segment", "e.doc", "e.start", "e.n", "c"))
    settle(spark)
    again = earliest.where("c > 1").select("anchor", "segment", F.struct("doc", "start").alias("e"), "c")
    copies = stash.put(spread_join(found, again, ["anchor", "segment"], found.count()).where(place != F.col("e")).select("doc", "start", "n"))
    stash.drop(found)
    settle(spark)
    mixed = stash.put(earliest.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    open_ = spread_join(earliest.select("anchor", "doc", "start", "n"), mixed, ["anchor"], earliest.count())
    bytes_ = F.expr(f"substring(cast(text AS binary), start + 1, n + {length - 1})").alias("bytes")
    segments = stash.put(df.join(open_, "doc").select(F.col("anchor").alias("key"), "doc", "start", bytes_, "c"))
    stash.drop(earliest, mixed)
    settle(spark)
    runs = [copies, stash.put(in_blocks(segments.where(F.col("c") <= HOT), length))]
    hot = segments.where(F.col("c") > HOT)
    if not hot.isEmpty():
        runs += split_hot(hot, stash, length)
    stash.drop(segments)
    return reduce(DataFrame.unionByName, runs)


def covered(starts: list[int], numbers: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    runs: list[tuple[int, int]] = []
    for s, n in sorted(zip(starts, numbers)):
        e = s + n + length - 1
        if runs and s <= runs[-1][1]:
            runs[-1] = runs[-1][0], max(e, runs[-1][1])
        else:
            runs.append((s, e))
    return runs


def dedup(spark: SparkSession, df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``removed``: (start, end) of maximal runs, and ``kept``: the bytes that stay."""
    stash = Stash(spark, "suffixes")
    keyed, same = by_row(df.select(id_col, text_col), id_col, text_col, stash)
    docs = keyed.select(F.col("row").alias("doc"), "text")
    runs = repeats(docs, stash, length)
    settle(spark)
    prints = stash.put(docs.where(F.octet_length("text") >= length).select("doc", F.unhex(F.md5("text")).alias("print")))
    first = stash.put(prints.groupBy("print").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    copies = spread_join(prints, first, ["print"], prints.count()).where("doc <> first").select("doc").withColumn("whole", F.lit(True))
    marks = runs.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("numbers"))
    marks = marks.join(copies, "doc", "full_outer")
    joined = docs.join(marks, "doc", "left")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, gone, kept = [], [], [], []
            for doc, text, starts, numbers, whole in zip(*(b.column(k).to_pylist() for k in range(5))):
                raw = (text or "").encode()
                cut = [(0, len(raw))] if whole else covered(starts, numbers, length) if starts else []
                at, parts = 0, []
                for s, e in cut:
                    parts.append(raw[at:s])
                    at = e
                ids.append(doc), sizes.append(len(raw)), gone.append([{"start": s, "end": e} for s, e in cut]), kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, spans), pa.array(kept, pa.binary())], ["doc", "n_bytes", "removed", "kept"])

    out = map_batches(joined.select("doc", "text", "starts", "numbers", "whole"), run, "doc long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    if same:
        return out.select(F.col("doc").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "removed", "kept")
    ids = keyed.select(F.col("row").alias("doc"), "id")
    return out.join(ids, "doc").select(F.col("id").alias(id_col), "n_bytes", "removed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark, documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
