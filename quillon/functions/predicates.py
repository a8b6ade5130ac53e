"""Document predicates in two-valued logic: a missing value is a value, and no predicate is ever null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which predicates a field kind allows.
ALLOWED = {
    "string": {"equals", "notEquals", "contains", "startsWith", "endsWith", "in", "notIn", "isDefined", "isUndefined"},
    "number": {"equals", "notEquals", "greaterThan", "greaterThanOrEqual", "lessThan", "lessThanOrEqual", "in", "notIn", "isDefined", "isUndefined"},
    "boolean": {"equals", "notEquals", "in", "notIn", "isDefined", "isUndefined"},
    "ref": {"equals", "notEquals", "in", "notIn", "isDefined", "isUndefined"},
}
_TYPES = {"string": str, "number": (int, float), "boolean": bool, "ref": str}


class InvalidQuery(ValueError):
    """A query that can't be run: unknown field, wrong kind, malformed pattern."""


def check_argument(kind: str, name: str, arg: object) -> None:
    if name not in ALLOWED[kind]:
        raise InvalidQuery(f"{name} isn't for {kind} fields")
    if name in ("isDefined", "isUndefined"):
        ok = isinstance(arg, bool)
    else:
        args = arg if name in ("in", "notIn") else [arg]
        ok = isinstance(args, list | tuple) and all(isinstance(x, _TYPES[kind]) and (kind != "number" or not isinstance(x, bool)) for x in args)
    if not ok:
        raise InvalidQuery(f"{name} of a {kind} field doesn't take {arg!r}")


def holds(name: str, value: Column, arg: object) -> Column:
    """The predicate over a value column (null: missing)."""
    tests = {
        "equals": lambda: value == F.lit(arg),
        "notEquals": lambda: ~value.eqNullSafe(F.lit(arg)),
        "greaterThan": lambda: value > F.lit(arg),
        "greaterThanOrEqual": lambda: value >= F.lit(arg),
        "lessThan": lambda: value < F.lit(arg),
        "lessThanOrEqual": lambda: value <= F.lit(arg),
        "contains": lambda: value.contains(arg),
        "startsWith": lambda: value.startswith(arg),
        "endsWith": lambda: value.endswith(arg),
        "in": lambda: value.isin(list(arg)),
        "notIn": lambda: ~F.coalesce(value.isin(list(arg)), F.lit(False)),
        "isDefined": lambda: value.isNotNull() if arg else value.isNull(),
        "isUndefined": lambda: value.isNull() if arg else value.isNotNull(),
    }
    return F.coalesce(tests[name](), F.lit(False))
