"""Typed values: a kind and one payload column, and when two are equal.

Numbers are equal when they differ by less than 2^-52. At magnitudes of 1 and above that is exact equality, so joins
use exact keys by default; NaN and infinities equal nothing, themselves included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.0**-52
#: Limits of a stored string, in bytes.
MIN_STRING, MAX_STRING = 1, 1024
KINDS = ("null", "bool", "num", "str", "ref")


@dataclass(frozen=True)
class Entity:
    """A constant entity id."""

    id: str


@dataclass(frozen=True)
class Ref:
    """A constant reference value."""

    id: str


def kind_of(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float):
        return "num"
    if isinstance(value, str):
        return "str"
    if isinstance(value, Ref | Entity):
        return "ref"
    raise TypeError(f"not a value: {value!r}")


def equals_constant(value: object, kind: Column, s: Column, n: Column, b: Column, r: Column) -> Column:
    """Whether a stored value equals a constant; a constant entity matches references to it."""
    of = kind_of(value)
    same = {
        "null": lambda: F.lit(True),
        "bool": lambda: b == F.lit(value),
        "num": lambda: F.abs(n - F.lit(float(value))) < EPSILON,
        "str": lambda: s == F.lit(value),
        "ref": lambda: r == F.lit(value.id),
    }[of]()
    if of == "num":  # NaN compares as the largest number, and so needs no care; an infinite difference is NaN
        same = same & ~F.isnan(n)
    return (kind == of) & F.coalesce(same, F.lit(False))


def number_key(n: Column) -> Column:
    """A text that is the same for equal finite numbers, null for others."""
    finite = ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return F.when(finite, F.concat(F.lit("n:"), (n + F.lit(0.0)).cast("string")))


def value_key(kind: Column, s: Column, n: Column, b: Column) -> Column:
    """A text that is the same for equal values; entities and references to them share one. Null equals nothing."""
    return (
        F.when(kind == "str", F.concat(F.lit("s:"), s))
        .when(kind.isin("ref", "entity"), F.concat(F.lit("r:"), s))
        .when(kind == "num", number_key(n))
        .when(kind == "bool", F.concat(F.lit("b:"), b.cast("string")))
        .when(kind == "null", F.lit("z"))
    )
