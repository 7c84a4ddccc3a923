"""Secret scans with multipart credential linking.

Base spans are what three patterns find. The method adds parts of credentials that
prove nothing alone and is strict about kinds. An *identifier* says whose credential it is: an access identifier, or an
assignment that holds one. A *secret* is an assignment or a weak candidate, a token that could be a key. An *endpoint*
says where it is used. A weak candidate is reported only when an identifier stands in its scope; a second secret beside it,
or an endpoint, doesn't complement it. An endpoint is reported only when it stands with an identifier or with a secret that is
itself reported. A scope is a paragraph, or ``REACH`` characters either way within it. Parts are linked by an interval
join on sorted positions and running maxima of ends: per candidate one binary search for the truly nearest
partners, so work is n log n in the parts of a text, never pairs.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; offsets count code points; the
end is exclusive; rows with equal texts have equal spans, whatever their ids; an empty table gives an empty table;
columns other than the id and the text are not carried along, whatever they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, ship

#: Kinds in the order of the report.
KINDS = ("assign", "access", "hex", "weak", "endpoint")
BASE = KINDS[:3]


def _either(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = re.compile(f"({_either('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: A word's worth of key material, and places where keys are used. '=' may stand before a key (name=key) and pad its end, but is never inside.
WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/?=&%-]*)?")
BREAK = re.compile(r"\n[ \t]*\n")
REACH = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Placed:
    """Spans by start, with the furthest end among those up to each."""

    def __init__(self, spans: list[Span]) -> None:
        spans = sorted(spans, key=lambda s: s[1])
        self.starts = [s[1] for s in spans]
        self.ends = list(accumulate((s[2] for s in spans), max))

    def overlap(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def near(self, a: int, b: int, breaks: list[int]) -> bool:
        """Whether a span lies in the scope of ``a`` to ``b``.

        Of those that start before, the one with the furthest end has the narrowest gap, and of the others the first.
        """
        k = bisect_left(self.starts, a)
        gaps = []
        if k > 0:
            gaps.append((self.ends[k - 1], a))
        if k < len(self.starts):
            gaps.append((b, self.starts[k]))
        return any(x >= y or (y - x <= REACH and bisect_left(breaks, x) == bisect_left(breaks, y)) for x, y in gaps)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates and endpoints whose complementary parts co-occur."""
    proofs = [s for s in base if s[0] != "hex"]
    if not proofs:
        return []
    breaks = [m.start() for m in BREAK.finditer(text)]
    access = Placed([s for s in proofs if s[0] == "access"])
    owners, taken = Placed([s for s in proofs if s[0] == "access" or access.overlap(*s[1:])]), Placed(base)
    weak = []
    for m in WEAK.finditer(text) if owners.starts else ():
        word, span = m[0], m.span()
        mixed = any(c.isdigit() for c in word) and any(c.isupper() for c in word) and any(c.islower() for c in word)
        if mixed and not taken.overlap(*span) and owners.near(*span, breaks):
            weak.append(("weak", *span))
    parts = Placed(proofs + weak)
    return weak + [("endpoint", *m.span()) for m in ENDPOINT.finditer(text) if parts.near(*m.span(), breaks)]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: (kind, start, end) structs by start, then kind as listed."""
    kind = df.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                spans = base + linked_spans(t, base) if base else []
                rows.append([dict(zip(("kind", "start", "end"), s)) for s in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, struct)], ["id", "spans"])

    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with every span replaced by ``mask``; all its columns stay, null texts too.

    Spans that overlap are replaced as one.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):  # type: ignore[no-untyped-def]
        return texts.map(lambda t: _masked(t, mask) if t else t)

    return df.withColumn(text_col, clean(F.col(text_col)))


def _masked(text: str, mask: str) -> str:
    base = base_spans(text)
    out, at = [], 0
    for _, a, b in sorted(base + linked_spans(text, base), key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
