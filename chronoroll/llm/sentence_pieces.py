"""SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut where no piece can reach across: before a run of word marks, around
line ends, and between letters and the signs that no piece joins to them. Every distinct cut is encoded once by an agenda of adjacent symbol
pairs ordered by score (``bpe.PairTable``) and then taken from a bounded cache. Of the
new cuts of an Arrow batch, those whose checksum is divisible by ``check_every`` (1:
all, 0: none) are also encoded by the sentencepiece library in one call; should the
two differ, the library's ids are used, and the column ``mended`` says in how many places of a text.

Defined results: a null or empty text has no ids and decodes to an empty text;
characters outside the vocabulary become byte pieces; U+2581 is a word mark like
a space; rows with equal texts have equal results; an empty table gives an empty table.
Columns other than the id and the text are not carried along, so their names can't clash.
"""

from __future__ import annotations

import functools
import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PairTable, Recent
from .common import documents, map_batches

MARK = "▁"
#: Symbols from here on are characters without a piece, by code point.
UNKNOWN = 1 << 20
#: Distinct cuts that a Python worker remembers, and rows that it takes at a time.
CACHE, ROWS = 400_000, 1000


class Codec:
    """A merge-type SentencePiece model: tables for the agenda, and the library beside it."""

    def __init__(self, model_path: str, check_every: int = 1) -> None:
        import sentencepiece

        self.library, self.check_every = sentencepiece.SentencePieceProcessor(model_file=model_path), check_every
        n = self.library.get_piece_size()
        lib = self.library
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        text = {lib.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in text) or any("\n" in p for p in text):
            raise ValueError("a piece reaches across words; texts of this vocabulary can't be cut")
        # ASCII signs that no piece has beside a letter or figure: texts are cut between the two,
        # but not beside other signs, which may join both.
        signs = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}
        beside = {p[k + d] for p in text for k in range(len(p) - 1) for d in (0, 1) if p[k + d] in signs and p[k + 1 - d] not in signs and p[k + 1 - d] != MARK}
        free, tied = ("".join(map(re.escape, sorted(x))) or "\n" for x in (signs - beside, beside))
        self.cut = re.compile(f"\n|{MARK}*(?:[^{MARK}\n{free}{tied}]++(?![{tied}])|[{free}]++(?![{tied}])|[^{MARK}\n]+)|{MARK}+").findall
        symbol = lambda s: text.get(s, UNKNOWN + ord(s) if len(s) == 1 else None)
        place = {s: k for k, s in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        pairs = {}
        for piece, i in text.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = place[-lib.get_score(i)], i
        self.table = PairTable(pairs)
        self.of_char = np.arange(0x110000, dtype=np.int32) + UNKNOWN
        for piece, i in text.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = np.array([lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)], object)
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        for i in range(n):
            if lib.is_control(i):
                self.bytes_of[i] = b""
        #: Cuts that the agenda and the library encode differently; none are known.
        self.known, self.mended = Recent(CACHE), set()

    def agenda(self, cuts: list[str]) -> list[bytes]:
        """Ids of each cut as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        ids, sizes = self.table.merge_all(self.of_char[np.frombuffer("".join(cuts).encode("utf-32-le"), "<u4")], sizes)
        ends = (np.cumsum(sizes) * 4).tolist()
        raw = ids.astype("<i4").tobytes()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for at in np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(ids >= UNKNOWN), "right")).tolist():
            spelled = [x for i in np.frombuffer(out[at], "<i4").tolist() for x in ([i] if i < UNKNOWN else [self.byte_ids[b] for b in chr(i - UNKNOWN).encode()])]
            out[at] = np.array(spelled, "<i4").tobytes()
        return out

    def by_library(self, cuts: list[str]) -> list[list[int]]:
        """A cut that starts with a mark gets it from the library; before others a line end keeps the two apart."""
        heads = [c[:1] == MARK for c in cuts]
        found = self.library.encode([c[1:] if h else "\n" + c for c, h in zip(cuts, heads)], num_threads=1)
        return [([self.library.piece_to_id(MARK)] if c == MARK else ids) if h else ids[2:] for c, h, ids in zip(cuts, heads, found)]

    def learn(self, cuts: set[str]) -> None:
        new = self.known.missing(cuts)
        own = self.agenda(new)
        if self.check_every:
            some = [k for k, c in enumerate(new) if self.check_every == 1 or zlib.crc32(c.encode()) % self.check_every == 0]
            mended = set()
            for k, ids in zip(some, self.by_library([new[k] for k in some])):
                if own[k] != (right := np.array(ids, "<i4").tobytes()):
                    own[k] = right
                    mended.add(new[k])
            if mended:
                self.mended |= mended
                logging.getLogger(__name__).warning("%d of %d cuts differ from the library, whose ids are used", len(mended), len(some))
        self.known.young.update(zip(new, own))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str | None]) -> tuple[list[bytes], list[int]]:
        """As ``encode``, and in how many places of each text the library's ids stand for the agenda's."""
        cuts = [self.cut(f"{MARK}{t.replace(' ', MARK)}") if t else [] for t in texts]
        self.learn(set().union(*cuts))
        get = self.known.young.__getitem__
        return [b"".join(map(get, c)) for c in cuts], [sum(x in self.mended for x in c) if self.mended else 0 for c in cuts]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode: one mark at the start goes, byte pieces are joined as UTF-8."""
        raw = b"".join(self.bytes_of[ids].tolist())
        try:
            return raw.decode()[1:] if raw[:1] == b" " else raw.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())


@functools.lru_cache(2)
def codec(model_path: str, check_every: int = 1) -> Codec:
    return Codec(model_path, check_every)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check_every: int = 1) -> DataFrame:
    """``id_col``, ``ids array<int>``, ``decoded string``, ``mended int`` for every row; no shuffle."""
    path = model_path or default_model()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, check_every)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                raw, mended = own.encode_checked(batch.column(1).to_pylist())
                ids = [np.frombuffer(r, "<i4") for r in raw]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(map(own.decode, ids), pa.string()), pa.array(mended, pa.int32())], ["id", "ids", "decoded", "mended"])

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, ids array<int>, decoded string, mended int")
    return out.withColumnRenamed("id", id_col)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("mended").cast("long").alias("n_mended"),
    )
