"""Media columns: content-addressed payloads in tar shards.

A payload is stored in its task's tar shard as an 8-bit greyscale PNG of 64
samples a line, under the digest of its stored form. A row carries that digest, the
shard, and the offset and length of the stored bytes. Payloads are written where their texts lie, so
no text is shuffled; a task stores equal payloads once. Where several tasks have stored the same digest, one place (the least)
is chosen for it and all rows of the digest point there; shards that nothing points to, such as those of failed
attempts, are deleted. Copies inside shards that are otherwise in use stay as unused bytes, at most one a task and digest.

Shards are written under the shared folder with a name of their own attempt and then renamed, so a task that runs again
never meets a half-written file. Metadata columns come from a range read of the
file's first 33 bytes, features from a range read of the whole file.

Defined results: a null or empty text is 64 bytes 0; rows with equal texts have equal values in all columns but the id, shard and
offset among them; ids may be null or repeat; texts of any length are one payload; an empty table gives an
empty table and no shards; columns other than the id and the text are not carried along, whatever they are called.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, documents, map_batches, new_folder

WIDTH, ROWS = 64, 1000
HEADER = 33
#: A shard is closed beyond this many bytes.
SHARD_BYTES = 256 << 20
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes) -> bytes:
    """Lossless: one sample a byte, lines without a filter."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first bytes alone."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("the range does not start with a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(stored: bytes) -> bytes:
    width, height, _ = read_header(stored[:HEADER])
    data, at = [], 8
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};step={step:.4f}"


class Shard:
    """A tar file on any store that pyarrow reaches, written once from start to end."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        self.store.create_dir(root)
        self.path = f"{root}/{uuid.uuid4().hex}.tar"
        self.out = self.store.open_output_stream(self.path + ".part")
        self.size = 0

    def add(self, name: str, data: bytes) -> int:
        """The offset of the data."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        at = self.size + len(head)
        tail = bytes(-len(data) % tarfile.BLOCKSIZE)
        self.out.write(head + data + tail)
        self.size = at + len(data) + len(tail)
        return at

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()
        self.store.move(self.path + ".part", self.path)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column(1).to_pylist():
        yield (t or "").encode()


def store(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads; rows of id, n_bytes, digest, shard, offset, length."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, ids, seen = None, [], [], {}

        def flush() -> pa.RecordBatch:
            cols = zip(*rows)
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, cols, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["id", "n_bytes", "digest", "shard", "offset", "length"])
            rows.clear(), ids.clear(), seen.clear()
            return out

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids.append(batch.column(0))
                shard = shard or Shard(folder)
                for raw in _texts(batch):
                    key = hashlib.sha256(raw).digest()
                    if key not in seen:
                        png = to_png(padded(raw))
                        digest = hashlib.sha256(png).hexdigest()
                        seen[key] = digest, shard.path, shard.add(f"{digest}.png", png), len(png)
                    rows.append((len(raw), *seen[key]))
                if shard.size > shard_bytes:
                    shard.close()
                    shard = None
                    yield flush()
        if shard:
            shard.close()
            yield flush()

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes long, digest string, shard string, offset long, length long")
    return out.withColumnRenamed("id", id_col)


def addressed(rows: DataFrame) -> DataFrame:
    """One place per digest: the least of those where tasks have stored it.

    Rows are joined by the place that their task gave them, which no other task's rows share, so a payload that a third of
    all rows hold makes no hot key.
    """
    place = F.struct("shard", "offset")
    places = rows.select("digest", "shard", "offset").distinct()
    least = places.groupBy("digest").agg(F.min(place).alias("to"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "to")
    moved = places.join(least, "digest").where(place != F.col("to")).select("shard", "offset", "to")
    found = rows.join(moved, ["shard", "offset"], "left")
    return found.select(*(F.coalesce(f"to.{c}", c).alias(c) if c in ("shard", "offset") else F.col(c) for c in rows.columns))


def sweep(rows: DataFrame, folder: str) -> int:
    """Delete files of the folder that no row points to; their number. One name per shard reaches the driver."""
    from pyarrow import fs

    store_, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    used = {r[0] for r in rows.select("shard").distinct().collect()}
    stray = [f.path for f in store_.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path not in used]
    for path in stray:
        store_.delete_file(path)
    return len(stray)


def _ranges(folder: str, rows: list[tuple[str, int, int]], limit: int | None) -> Iterator[bytes]:
    """The bytes of each range, at most ``limit`` of each; one file is open at a time."""
    from pyarrow import fs

    files, _ = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    name, file, last, data = None, None, None, b""
    for shard, offset, length in rows:
        if (shard, offset) != last:
            if shard != name:
                name, file = shard, files.open_input_file(shard)
            data = file.read_at(length if limit is None else min(limit, length), offset)
            last = shard, offset
        yield data


def metadata(rows: DataFrame, folder: str) -> DataFrame:
    """Add width, height and bits, from range reads of the headers alone."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = list(zip(*(b.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length"))))
            found = [read_header(x) for x in _ranges(folder, ranges, HEADER)]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in cols)], [*names, "width", "height", "bits"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, run, f"{fields}, width long, height long, bits long")


def read_back(rows: DataFrame, folder: str) -> DataFrame:
    """Add what the stored bytes say: digests, the payload's tail and its features."""
    names = rows.columns
    added = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple] = {}
        for b in batches:
            ranges = list(zip(*(b.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length"))))
            new = sorted({r for r in ranges if r[:2] not in known})
            if len(known) > 50_000:
                known, new = {}, sorted(set(ranges))
            for (shard, offset, _), stored in zip(new, _ranges(folder, new, None)):
                payload = from_png(stored)
                known[shard, offset] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(stored).hexdigest(), features(payload)
            cols = list(zip(*(known[r[:2]] for r in ranges))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols, kinds)], [*names, *added])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, run, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    stash = Stash(spark, "media-rows")
    rows = stash.put(addressed(stash.put(store(documents(spark, sf_dir), folder))))
    sweep(rows, folder)
    out = read_back(metadata(rows, folder), folder)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "digest", "shard", "offset", "width", "height", "bits")
