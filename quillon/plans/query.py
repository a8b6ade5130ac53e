"""A query over triples: what to find, and patterns that must, may and must not match."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions.predicates import InvalidQuery
from ..functions.values import Entity, Ref, kind_of


@dataclass(frozen=True)
class Var:
    """A variable; its identity is its name."""

    name: str


#: What stands in a pattern: a variable, or a constant of the position's type.
Subject = Var | Entity | str
Attribute = Var | str
Object = Var | Entity | Ref | str | float | int | bool | None


@dataclass(frozen=True)
class Pattern:
    entity: Subject
    attribute: Attribute
    value: Object

    def __post_init__(self):
        if not isinstance(self.entity, Var | Entity | str) or not isinstance(self.attribute, Var | str):
            raise InvalidQuery(f"malformed pattern {self!r}")
        for x in (self.entity, self.attribute, self.value):
            if isinstance(x, Var) and not x.name:
                raise InvalidQuery("a variable needs a name")
        if not isinstance(self.value, Var):
            try:
                kind_of(self.value)
            except TypeError as e:
                raise InvalidQuery(str(e)) from e

    @property
    def variables(self) -> list[str]:
        """Names in binding order (entity, attribute, value), each once."""
        return list(dict.fromkeys(x.name for x in (self.entity, self.attribute, self.value) if isinstance(x, Var)))


@dataclass
class Query:
    """Phases run in a fixed order: where, optional, where_not, filters, find."""

    find: list[str]
    where: list[Pattern] = field(default_factory=list)
    optional: list[Pattern] = field(default_factory=list)
    #: Each is a group that must not match as a whole; a group of one is a plain negation.
    where_not: list[list[Pattern]] = field(default_factory=list)
    #: A variable and a function from its Binding to a boolean column; null counts as false.
    filters: list[tuple[str, Callable[..., Column]]] = field(default_factory=list)

    def must(self, entity: Subject, attribute: Attribute, value: Object) -> Query:
        self.where.append(Pattern(entity, attribute, value))
        return self

    def may(self, entity: Subject, attribute: Attribute, value: Object) -> Query:
        self.optional.append(Pattern(entity, attribute, value))
        return self

    def must_not(self, entity: Subject, attribute: Attribute, value: Object) -> Query:
        """Independent of other negations."""
        self.where_not.append([Pattern(entity, attribute, value)])
        return self

    def must_not_all(self, *patterns: tuple) -> Query:
        """No solution may satisfy all of these together."""
        self.where_not.append([Pattern(*p) for p in patterns])
        return self

    def having(self, variable: str, test: Callable[..., Column]) -> Query:
        self.filters.append((variable, test))
        return self
