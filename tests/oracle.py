"""A nested-loop evaluator of queries over a list of triples: the tests' second opinion, slow and plain."""

from __future__ import annotations

from quillon.functions.values import EPSILON, Entity, Ref
from quillon.plans.query import Query, Var


def same_value(x, y) -> bool:
    """Both are (kind, payload)."""
    if x[0] != y[0]:
        return False
    if x[0] == "num":
        return abs(x[1] - y[1]) < EPSILON
    return x[0] == "null" or x[1] == y[1]


def constant(v):
    if v is None:
        return ("null", None)
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int | float):
        return ("num", float(v))
    if isinstance(v, Ref | Entity):
        return ("ref", v.id)
    return ("str", v)


def agrees(bound, new) -> bool:
    """Entities and references to them are one; fields are only fields."""
    names = ("entity", "ref")
    if bound[0] in names and new[0] in names:
        return bound[1] == new[1]
    if "field" in (bound[0], new[0]):
        return bound == new
    return bound[0] not in names and new[0] not in names and same_value(bound, new)


def match(context: dict, pattern, triple) -> dict | None:
    out = dict(context)
    e, a, v = triple
    for part, seen in ((pattern.entity, ("entity", e)), (pattern.attribute, ("field", a)), (pattern.value, v)):
        if isinstance(part, Var):
            if out.get(part.name) is not None:
                if not agrees(out[part.name], seen):
                    return None
            else:
                out[part.name] = seen
        elif part is pattern.entity and (part.id if isinstance(part, Entity) else part) != e:
            return None
        elif part is pattern.attribute and part is not pattern.entity and part != a:
            return None
        elif part is pattern.value and part is not pattern.entity and part is not pattern.attribute and not same_value(constant(part), v):
            return None
    return out


def extend(contexts, pattern, triples):
    return [m for c in contexts for t in triples if (m := match(c, pattern, t)) is not None]


def evaluate(triples, query: Query):
    contexts = [{}]
    for p in query.where:
        contexts = extend(contexts, p, triples)
    for p in query.optional:
        contexts = [m for c in contexts for m in (extend([c], p, triples) or [c])]
    for group in query.where_not:
        kept = []
        for c in contexts:
            inner = [c]
            for p in group:
                inner = extend(inner, p, triples)
            if not inner:
                kept.append(c)
        contexts = kept
    return [tuple(c.get(v) for v in query.find) for c in contexts]
