"""Bands and roundings of measured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024 * 1024


def ladder(value: Column, steps: list[tuple[float, str]], last: str, missing: str | None = None) -> Column:
    """The name of the first step that holds the value (value <= step)."""
    out = F.when(value.isNull(), missing) if missing is not None else F.when(F.lit(False), "")
    for limit, name in steps:
        out = out.when(value <= limit, name)
    return out.otherwise(last)


def count_band(n: Column) -> Column:
    return ladder(n, [(5, "1-5"), (20, "6-20"), (100, "21-100")], ">100")


def size_band(size: Column) -> Column:
    return F.when(size.isNull(), "unknown").when(size < MIB, "<1").when(size < 10 * MIB, "1-10").when(size <= 50 * MIB, "10-50").otherwise(">50")


def unreadable_size_band(size: Column) -> Column:
    """The size bands with more steps at the top, as reported for unreadable files."""
    return F.when(size.isNull() | (size <= 50 * MIB), size_band(size)).when(size <= 150 * MIB, "50-150").when(size <= 600 * MIB, "150-600").otherwise(">600")


def fit_band(ratio: Column) -> Column:
    return ladder(ratio, [(1.1, "<=1.1"), (1.5, "<=1.5"), (2, "<=2")], ">2")


def rounded_duration(ms: Column) -> Column:
    """Milliseconds to seconds, then to the nearest five; both round half up."""
    return (F.floor(F.floor(ms / 1000 + 0.5) / 5 + 0.5) * 5).cast("long")


def extension(name: Column) -> Column:
    """The lower-case extension of one to eight letters or digits; ``other`` for a longer or odd one, ``none`` without a dot."""
    found = F.regexp_extract(F.lower(name), r"\.([a-z0-9]{1,8})$", 1)
    return F.when(found != "", found).when(F.contains(name, F.lit(".")), "other").otherwise("none")
