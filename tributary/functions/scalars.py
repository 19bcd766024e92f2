"""Scalar expressions that flows share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def bucketise(value: Column | str, ladder: list[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first rung whose bound the value does not exceed."""
    value = F.col(value) if isinstance(value, str) else value
    out = None
    for bound, name in ladder:
        out = (F if out is None else out).when(value <= bound, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def guarded_divide(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def saturating_add(a: Column, b: Column) -> Column:
    """a + b as a long that stops at the type's bounds."""
    total = F.try_add(a, b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(total, F.when(b > 0, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))))


def saturating_subtract_to_zero(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def spelled_digit(char: Column) -> Column:
    """Word for a digit character, other characters unchanged."""
    words = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    names = F.create_map(*(x for i, w in enumerate(words) for x in (F.lit(str(i)), F.lit(w))))
    return F.coalesce(F.element_at(names, char), char)


def swap_to_upper(char: Column) -> Column:
    return F.upper(char)


def characters(text: Column) -> Column:
    """A string's characters as an array."""
    return F.filter(F.split(text, "", -1), lambda c: c != "")
