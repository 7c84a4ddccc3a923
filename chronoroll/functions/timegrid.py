"""Labels of periods. A label is the end of its period; periods are (label - res, label]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: microseconds from 0001-01-01 to 1970-01-01; periods are counted from there, so weeks end on Mondays.
ORIGIN = 62_135_596_800_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def ceil_us(us: int, res: int) -> int:
    return -(-(us + ORIGIN) // res) * res - ORIGIN


def ceil_micros(us: Column, res: int) -> Column:
    """In whole numbers throughout: doubles can't hold today's microseconds."""
    over = F.pmod(us + F.lit(ORIGIN), F.lit(res))
    return F.when(over == 0, us).otherwise(us - over + F.lit(res))


def bucket(label: Column, until: int, res: int) -> Column:
    """The label of a coarser period on the grid that ends at ``until``."""
    back = F.lit(until) - label
    return F.lit(until) - (back - F.pmod(back, F.lit(res)))
