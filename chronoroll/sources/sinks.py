"""Results as CSV files and as a table of text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: Iterable[str]) -> None:
    """Time, fields, then dimensions; field values with six decimals."""
    fields = list(fields)
    rest = [c for c in df.columns if c != "_time" and c not in fields]
    df.select("_time", *(F.format_string("%f", F.col(f"`{c}`")).alias(c) for c in fields), *(f"`{c}`" for c in rest)).write.mode("overwrite").csv(path, header=True)


def text_table(df: DataFrame, fields: Iterable[str], most: int = 1000) -> str:
    """The first rows: time, dimensions by name, fields with four decimals; ``-----`` for no value.

    A last line says so where there are more than ``most``.
    """
    fields = list(fields)
    dims = sorted(c for c in df.columns if c != "_time" and c not in fields)
    rows, found = [["# time", *dims, *fields]], df.limit(most + 1).collect()
    for r in found[:most]:
        time = r["_time"].strftime("%a, %d %b %Y %H:%M:%S UTC")
        rows.append([time, *("-----" if r[d] is None else str(r[d]) for d in dims), *(f"{r[f]:.4f}" for f in fields)])
    wide = [max(len(row[k]) for row in rows) for k in range(len(rows[0]))]
    lines = ["  ".join(c.ljust(w) if k <= len(dims) else c.rjust(w) for k, (c, w) in enumerate(zip(row, wide))).rstrip() for row in rows]
    return "\n".join(lines + [f"# only the first {most} rows"] * (len(found) > most))
