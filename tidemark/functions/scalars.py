"""Scalar rules of the data model; missing numbers are null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First hour of each session and its name.
SESSIONS = ((0, "asia"), (8, "london"), (13, "london_ny_overlap"), (17, "new_york"), (22, "late"))


def session_of(hour: Column) -> Column:
    out = F.lit(None).cast("string")
    for first, name in SESSIONS:
        out = F.when(hour >= first, name).otherwise(out)
    return out


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def compression_state(rank: Column, low: float = 0.2, high: float = 0.8) -> Column:
    return F.when(rank.isNull(), "unknown").when(rank <= low, "compressed").when(rank >= high, "expanding").otherwise("neutral")


def floored(x: Column) -> Column:
    """max(0, x) that keeps null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0), x))


def points(price: Column, size: float) -> Column:
    return F.rint(price / size).cast("long")
