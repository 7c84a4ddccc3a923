"""Statistics of whole texts, one row of numbers per document, in Arrow batches.

Words are runs of anything but ASCII white space, lines are split at line ends. A null
or empty text has no words, and every ratio of it is 0. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "log_words", "mean_word", "std_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "punct_ratio",
    "odd_ratio", "bang_ratio", "pipe_ratio", "stop_ratio", "caps_word_ratio", "symbol_word_ratio", "words_a_line", "line_end_ratio", "top_word_ratio", "wide_ratio",
)
ALL = COUNTS + RATIOS
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes by class.
_IS = {
    "symbol": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "punct": b".,;:?!'\"-()",
    "odd": b"{}[]\\/_=+^~`@",
    "bang": b"!",
    "pipe": b"|",
    "space": SPACE,
}
_TABLE = np.zeros((256, len(_IS)), np.int64)
for _k, _set in enumerate(_IS.values()):
    _TABLE[list(_set), _k] = 1
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words in windows that are found twice or more; exact, as the keys of windows are."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**window < 2**63:
        key = np.zeros(n, np.int64)
        for k in range(window):
            key = key * base + ids[k : k + n]
    else:
        key = ids[:n]
        for k in range(1, window):
            key = np.unique(key * base + ids[k : k + n], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n + window, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    twice[at] += 1
    twice[at + window] -= 1
    return int((np.cumsum(twice) > 0).sum())


def statistics(text: str | None) -> tuple[float, ...]:
    """COUNTS and RATIOS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        symbols = len(_SYMBOLS.findall(raw))
        return (0, 0, symbols, 0, 0) + (0.0,) * len(RATIOS)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    classes = dict(zip(_IS, (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE).tolist()))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    chars = len(text or "") - classes["space"]
    repeat = repeated_words(ids)
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    mean = float(sizes @ counts) / n
    caps = np.fromiter((w.isupper() and len(w) > 1 for w in number), bool, len(number))
    marked = np.fromiter((_SYMBOLS.search(w) is not None for w in number), bool, len(number))
    short = sizes <= 3
    plain = max(1, len(raw))
    ratios = (
        float(np.log1p(n)), mean, float(np.sqrt(max(0.0, float((sizes**2) @ counts) / n - mean * mean))),
        classes["symbol"] / plain, dup_lines / max(1, len(lines)), repeat / n, len(number) / n, classes["upper"] / plain, classes["digit"] / plain,
        classes["punct"] / plain, classes["odd"] / plain, classes["bang"] / plain, classes["pipe"] / plain, float(counts[short].sum()) / n,
        float(counts[caps].sum()) / n, float(counts[marked].sum()) / n, n / len(lines), sum(line.rstrip(SPACE)[-1:] in b".?!" for line in lines) / len(lines),
        float(counts.max()) / n, (len(raw) - len(text or "")) / plain,
    )
    return (n, chars, classes["symbol"], dup_lines, repeat) + ratios


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ALL as columns, counts as long and ratios as double."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(statistics, b.column(1).to_pylist()))) or [()] * len(ALL)
            kinds = [pa.int64() if c in COUNTS else pa.float64() for c in ALL]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["id", *ALL])

    fields = ", ".join(f"{c} {'long' if c in COUNTS else 'double'}" for c in ALL)
    out = map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, {fields}")
    return out.withColumnRenamed("id", id_col)


def sample_by_hash(df: DataFrame, most: int, by: list[str], seed: int = 7) -> DataFrame:
    """About ``most`` rows, all if there are no more, by hashes of the columns ``by`` alone, so reruns agree."""
    share = min(1.0, most / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) < int(share * (1 << 30)))
