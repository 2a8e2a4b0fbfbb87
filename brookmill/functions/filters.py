"""Predicates that pass everything where their parameter is absent, and fail a null where it isn't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between_or_pass(col: Column, low, high) -> Column:
    """Inclusive range; passes all unless both bounds are given."""
    return F.lit(True) if low is None or high is None else F.coalesce(col.between(low, high), F.lit(False))


def in_or_pass(col: Column, values) -> Column:
    return F.lit(True) if not values else F.coalesce(col.isin(list(values)), F.lit(False))


def overlap_or_pass(col: Column, values, kind: str = "string") -> Column:
    """An array column holds any of the values."""
    return F.lit(True) if not values else F.coalesce(F.arrays_overlap(col, F.lit(list(values)).cast(f"array<{kind}>")), F.lit(False))


def equal_or_pass(col: Column, value) -> Column:
    return F.lit(True) if value is None or value == "" else F.coalesce(col == value, F.lit(False))
