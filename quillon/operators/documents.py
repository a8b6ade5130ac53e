"""Schema-typed documents over triples: create, select, filter, order, limit, aggregate, relate and page.

A document query is one star: a scan of a wide table, or one pivot of a triple table. Order and limit become a
top-k without a full sort; fallbacks are filled in last, so they neither sort nor limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import InvalidQuery, check_argument, holds
from ..plans.compile import run
from ..plans.query import Query, Var
from ..sources.triples import TripleSource

RESERVED = ("id", "createTime", "updateTime", "creator")
_FORMS = {"string": "str", "number": "num", "boolean": "bool", "ref": "id"}
_TYPES = {"string": str, "number": (int, float), "boolean": bool}


@dataclass(frozen=True)
class Field:
    """A field: its kind (string, number, boolean, ref), whether it may be missing, its fallback and target."""

    kind: str
    optional: bool = False
    fallback: Any = None
    target: str | None = None

    def __post_init__(self):
        if self.kind not in _FORMS:
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == "ref":
            if not self.optional or self.fallback is not None:
                raise ValueError("a reference is optional and has no fallback")
        elif not self.optional and self.fallback is None:
            raise ValueError("a required field needs a fallback")
        elif self.fallback is not None and (not isinstance(self.fallback, _TYPES[self.kind]) or (self.kind == "number" and isinstance(self.fallback, bool))):
            raise ValueError(f"the fallback {self.fallback!r} isn't a {self.kind}")


def string(fallback: str | None = None, optional: bool = False) -> Field:
    return Field("string", optional, fallback)


def number(fallback: float | None = None, optional: bool = False) -> Field:
    return Field("number", optional, fallback)


def boolean(fallback: bool | None = None, optional: bool = False) -> Field:
    return Field("boolean", optional, fallback)


def ref(target: str) -> Field:
    return Field("ref", True, None, target)


class Schema:
    """Entity types and their fields."""

    def __init__(self, entities: dict[str, dict[str, Field]]):
        for name, fields in entities.items():
            if bad := set(fields) & set(RESERVED):
                raise ValueError(f"{name}: reserved field names {sorted(bad)}")
        self.entities = entities

    def field(self, entity: str, name: str) -> Field:
        if entity not in self.entities:
            raise InvalidQuery(f"unknown entity type {entity!r}")
        if name == "id":
            return Field("string", True)
        if name not in self.entities[entity]:
            raise InvalidQuery(f"{entity} has no field {name!r}")
        return self.entities[entity][name]


def normal_filters(where: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """A bare value stands for equality."""
    return {f: x if isinstance(x, dict) else {"equals": x} for f, x in where.items()}


class Documents:
    """The documents of one entity type in a source."""

    def __init__(self, source: TripleSource, schema: Schema, entity: str):
        if entity not in schema.entities:
            raise InvalidQuery(f"unknown entity type {entity!r}")
        self.source, self.schema, self.entity = source, schema, entity

    def _raw(self, fields: list[str]) -> DataFrame:
        """id and the given fields without fallbacks, of every entity that has the marker attribute."""
        names = [f for f in dict.fromkeys(fields) if f != "id"]
        q = Query(["id", *names]).must(Var("id"), f"{self.entity}/id", Var("__marker"))
        for f in names:
            q.may(Var("id"), f"{self.entity}/{f}", Var(f))
        return run(self.source, q, {"id": "id"} | {f: _FORMS[self.schema.field(self.entity, f).kind] for f in names})

    def _filled(self, name: str) -> Column:
        fb = self.schema.field(self.entity, name).fallback
        return F.col(name) if fb is None else F.coalesce(F.col(name), F.lit(float(fb) if isinstance(fb, int) and not isinstance(fb, bool) else fb))

    def _filtered(self, fields: list[str], where: dict[str, Any], order: list[tuple[str, str]]) -> DataFrame:
        tests = normal_filters(where)
        for f, test in tests.items():
            for name, arg in test.items():
                check_argument(self.schema.field(self.entity, f).kind, name, arg)
        for f in (*fields, *(f for f, _ in order)):
            self.schema.field(self.entity, f)
        rows = self._raw([*fields, *tests, *(f for f, _ in order)])
        for f, test in tests.items():
            for name, arg in test.items():
                # Presence is that of the stored value; other predicates see the fallback.
                rows = rows.where(holds(name, F.col(f) if name in ("isDefined", "isUndefined") else self._filled(f), arg))
        return rows

    def query(self, fields: list[str], where: dict[str, Any] | None = None, order_by: list[tuple[str, str]] | None = None, limit: int | None = None, only_selected: bool = False) -> DataFrame:
        """Documents with the given fields. Missing values come last in either direction and sort before fallbacks.

        only_selected leaves out sort keys that aren't among the fields.
        """
        order = [x for x in order_by or [] if not only_selected or x[0] in fields]
        rows = self._filtered(fields, where or {}, order)
        if order:
            rows = rows.orderBy(*[F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last() for f, d in order])
        if limit is not None:
            if limit < 0:
                raise InvalidQuery("a limit isn't negative")
            rows = rows.limit(limit)
        return rows.select(*[F.col(f) if f == "id" else self._filled(f).alias(f) for f in dict.fromkeys(fields)])

    def query_one(self, fields: list[str], where: dict[str, Any] | None = None, order_by: list[tuple[str, str]] | None = None) -> DataFrame:
        return self.query(fields, where, order_by, 1)

    def aggregate(self, aggregates: dict[str, tuple[str, str]], group_by: list[str] | None = None, where: dict[str, Any] | None = None, order_by: list[tuple[str, str]] | None = None, limit: int | None = None) -> DataFrame:
        """name -> (count|sum|avg|min|max, field or *); by groups if any. Missing values fall back first."""
        if not aggregates:
            raise InvalidQuery("groups need aggregates")
        groups = group_by or []
        used = [f for _, f in aggregates.values() if f != "*"]
        rows = self._filtered([*groups, *used], where or {}, [])
        rows = rows.select(*[F.col(f) if f == "id" else self._filled(f).alias(f) for f in dict.fromkeys(["id", *groups, *used])])
        made = []
        for name, (how, f) in aggregates.items():
            if how not in ("count", "sum", "avg", "min", "max") or (f == "*" and how != "count"):
                raise InvalidQuery(f"unknown aggregate {how}({f})")
            if how in ("sum", "avg") and self.schema.field(self.entity, f).kind != "number":
                raise InvalidQuery(f"{how} needs a number field")
            made.append((F.count("*") if f == "*" else getattr(F, how)(f)).alias(name))
        out = rows.groupBy(*groups).agg(*made)
        if order_by:
            out = out.orderBy(*[F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last() for f, d in order_by])
        return out if limit is None else out.limit(limit)

    def page(self, fields: list[str], order_by: str | list[tuple[str, str]], size: int, after: tuple[Any, ...] | None = None, where: dict[str, Any] | None = None, before: tuple[Any, ...] | None = None) -> DataFrame:
        """A page by key, in page order: the rows behind the last one seen, or those before the first one.

        A place is a row's sort values and its id, by which ties are broken (upwards). Missing values come last in
        either direction. Pages cost a top-k each, however far on they are.
        """
        if after is not None and before is not None:
            raise InvalidQuery("a page is behind a place or before one")
        order = [(order_by, "asc")] if isinstance(order_by, str) else list(order_by)
        keys = [*order, ("id", "asc")]
        rows = self._filtered([*fields, "id"], where or {}, order)
        place = after if after is not None else before
        if place is not None:
            if len(place) != len(keys):
                raise InvalidQuery("a place has a value for each sort key, and an id")
            same, hit = F.lit(True), F.lit(False)
            for (f, d), value in zip(keys, place, strict=True):
                c, up = F.col(f), (d == "asc") == (after is not None)
                if value is None:  # behind missing values there are none but missing ones
                    further = F.lit(False) if after is not None else c.isNotNull()
                    equal = c.isNull()
                else:
                    further = (c > F.lit(value) if up else c < F.lit(value)) | (c.isNull() if after is not None else F.lit(False))
                    equal = c == F.lit(value)
                hit = hit | (same & further)
                same = same & equal
            rows = rows.where(F.coalesce(hit, F.lit(False)))
        ahead = [F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last() for f, d in keys]
        back = [F.col(f).desc_nulls_first() if d == "asc" else F.col(f).asc_nulls_first() for f, d in keys]
        rows = rows.orderBy(*(back if before is not None else ahead)).limit(size)
        rows = rows.orderBy(*ahead) if before is not None else rows
        return rows.select(*[F.col(f) if f == "id" else self._filled(f).alias(f) for f in dict.fromkeys(["id", *fields])])

    def page_totals(self, size: int, where: dict[str, Any] | None = None) -> DataFrame:
        """How many documents and pages there are, by one partial aggregate."""
        return self._filtered(["id"], where or {}, []).agg(F.count("*").alias("n")).select("n", F.ceil(F.col("n") / size).cast("bigint").alias("pages"))

    def related(self, fields: list[str], child: Documents, via: str, child_fields: list[str], name: str, order_by: tuple[str, str], limit: int) -> DataFrame:
        """Documents with, as an array, the first children that refer to them, in order."""
        f, d = order_by
        rows = child._filtered([*child_fields, via, f], {}, [])
        key = F.col(f).asc_nulls_last() if d == "asc" else F.col(f).desc_nulls_last()
        w = Window.partitionBy(via).orderBy(key, "id")
        # Groups are cut by rank before they are collected, so no array is longer than the limit.
        rows = rows.where(F.col(via).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit)
        item = F.struct("__n", *[F.col(c) if c == "id" else child._filled(c).alias(c) for c in child_fields])
        lists = rows.groupBy(F.col(via).alias("id")).agg(F.sort_array(F.collect_list(item)).alias("__l"))
        lists = lists.select("id", F.transform("__l", lambda x: F.struct(*[x[c].alias(c) for c in child_fields])).alias(name))
        return self.query(list(dict.fromkeys(["id", *fields]))).join(lists, "id", "left")

    def create(self, docs: DataFrame, id: str = "id") -> DataFrame:
        """Triples for rows of documents: the marker and one for each value that is there; unknown fields are refused.

        A required field without a value raises when the plan runs.
        """
        fields = self.schema.entities[self.entity]
        if unknown := [c for c in docs.columns if c != id and c not in fields]:
            raise InvalidQuery(f"{self.entity} has no fields {unknown}")
        if missing := [f for f, x in fields.items() if not x.optional and f not in docs.columns]:
            raise InvalidQuery(f"{self.entity} needs the fields {missing}")
        items = [self._triple("id", F.col(id), "string")]
        for f in (c for c in docs.columns if c != id):
            value = F.col(f)
            if not fields[f].optional:
                value = F.when(value.isNull(), F.raise_error(F.lit(f"{self.entity} needs the field {f}")).cast(dict(docs.dtypes)[f])).otherwise(value)
            items.append(self._triple(f, value, fields[f].kind))
        rows = docs.select(F.col(id).alias("e"), F.explode(F.array(*items)).alias("t")).select("e", "t.*")
        return rows.where("kind IS NOT NULL")

    def _triple(self, name: str, value: Column, kind: str) -> Column:
        form = {"string": "str", "number": "num", "boolean": "bool", "ref": "ref"}[kind]
        none = lambda t: F.lit(None).cast(t)
        return F.struct(
            F.lit(f"{self.entity}/{name}").alias("a"),
            F.when(value.isNotNull(), F.lit(form)).alias("kind"),
            (value.cast("string") if form == "str" else none("string")).alias("s"),
            (value.cast("double") if form == "num" else none("double")).alias("n"),
            (value.cast("boolean") if form == "bool" else none("boolean")).alias("b"),
            (value.cast("string") if form == "ref" else none("string")).alias("r"),
        )

    def replace(self, docs: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
        """New triples of whole documents, and the (e, a) keys of their old fields that are not set again."""
        new = self.create(docs, id)
        old = self.source.scan().select("e", "a").join(docs.select(F.col(id).alias("e")).distinct(), "e", "left_semi")
        return new, old.join(new.select("e", "a"), ["e", "a"], "left_anti")

    def update_many(self, where: dict[str, Any], changes: dict[str, Column | Any]) -> DataFrame:
        """Triples that set fields of the matching documents; a column expression sees the old values."""
        for f in changes:
            if f == "id":
                raise InvalidQuery("the id can't be changed")
            self.schema.field(self.entity, f)
        names = list(self.schema.entities[self.entity]) if any(isinstance(x, Column) for x in changes.values()) else list(changes)
        rows = self._filtered(["id", *names], where, [])
        items = [self._triple(f, x if isinstance(x, Column) else F.lit(x), self.schema.field(self.entity, f).kind) for f, x in changes.items()]
        return rows.select(F.col("id").alias("e"), F.explode(F.array(*items)).alias("t")).select("e", "t.*").where("kind IS NOT NULL")

    def delete_many(self, where: dict[str, Any]) -> DataFrame:
        """The (e, a) keys of the matching documents, for mvcc.delete."""
        ids = self._filtered(["id"], where, []).select(F.col("id").alias("e"))
        return self.source.scan().select("e", "a").join(ids, "e", "left_semi")
