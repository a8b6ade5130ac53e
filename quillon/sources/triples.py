"""Sources of triples.

A source gives the rows (e, a, kind, s, n, b, r) for an attribute, an entity or everything. A table source keeps a
column of triples; a wide source presents tables of ordinary columns as triples: a constant attribute is then a column
of one table, read by a column-pruned scan, and a star of attributes of one entity is one scan without any join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("e", "a", "kind", "s", "n", "b", "r")
SCHEMA = "e string, a string, kind string, s string, n double, b boolean, r string"


def payload(value: Column, kind: str) -> list[Column]:
    """kind, s, n, b, r of a column of values."""
    none = lambda t: F.lit(None).cast(t)
    return [
        F.lit(kind).alias("kind"),
        (value.cast("string") if kind == "str" else none("string")).alias("s"),
        (value.cast("double") if kind == "num" else none("double")).alias("n"),
        (value.cast("boolean") if kind == "bool" else none("boolean")).alias("b"),
        (value if kind == "ref" else none("string")).alias("r"),
    ]


class TripleSource:
    """A DataFrame of triples; single: at most one value for an entity and attribute."""

    def __init__(self, df: DataFrame, single: bool = True):
        self.df, self.single = df.select(*COLUMNS), single

    def scan(self, entity: str | None = None, attribute: str | None = None) -> DataFrame:
        out = self.df
        if entity is not None:
            out = out.where(F.col("e") == entity)
        return out if attribute is None else out.where(F.col("a") == attribute)

    def star(self, attributes: list[str]) -> DataFrame | None:
        """e, and for the i-th attribute kind_i, s_i, n_i, b_i, r_i; one row an entity that has any of them."""
        if not self.single:
            return None
        rows = self.df.where(F.col("a").isin(attributes))
        pick = [F.max(F.when(F.col("a") == a, F.col(c))).alias(f"{c}_{i}") for i, a in enumerate(attributes) for c in ("kind", "s", "n", "b", "r")]
        return rows.groupBy("e").agg(*pick)


@dataclass(frozen=True)
class Table:
    """A wide table as an entity type: its key, and of its columns kind and, for references, the entity type."""

    name: str
    key: str
    columns: dict[str, str]
    refs: dict[str, str] = field(default_factory=dict)
    #: Conditions under which a column has a value (SQL); others always have one unless null.
    present: dict[str, str] = field(default_factory=dict)


class Frames(dict):
    """Tables of a folder, opened when they are first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df


class WideSource(TripleSource):
    """Tables as triples: entity "<table>:<key>", attribute "<table>/<column>", marker attribute "<table>/id"."""

    single = True

    def __init__(self, frames: dict[str, DataFrame], tables: list[Table]):
        self.frames, self.tables = frames, {t.name: t for t in tables}

    def _entity(self, t: Table) -> Column:
        return F.concat(F.lit(f"{t.name}:"), F.col(t.key).cast("string"))

    @staticmethod
    def _key_is(rows: DataFrame, key: str, text: str) -> Column:
        """Whether a key's text is the given one; compared in the key's own type, so that the filter reaches the file scan."""
        kind = rows.schema[key].dataType
        if isinstance(kind, T.StringType):
            return F.col(key) == text
        if not isinstance(kind, T.IntegralType):
            return F.col(key).cast("string") == text
        bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[kind.simpleString()]
        if not re.fullmatch(r"0|-?[1-9][0-9]*", text) or not -(1 << bits - 1) <= int(text) < 1 << bits - 1:
            return F.lit(False)
        return F.col(key) == F.lit(int(text)).cast(kind)

    def _column(self, t: Table, column: str) -> tuple[Column, str]:
        if column == "id":
            return self._entity(t), "str"
        if column in t.refs:
            value, kind = F.concat(F.lit(f"{t.refs[column]}:"), F.col(column).cast("string")), "ref"
        else:
            value, kind = F.col(column), t.columns[column]
        return (F.when(F.expr(t.present[column]), value) if column in t.present else value), kind

    def _attributes(self) -> list[str]:
        return [f"{t.name}/{c}" for t in self.tables.values() for c in ("id", *t.columns, *t.refs)]

    def _known(self, attribute: str) -> tuple[Table, str] | None:
        name, _, column = attribute.partition("/")
        t = self.tables.get(name)
        return (t, column) if t and (column == "id" or column in t.columns or column in t.refs) else None

    def _triple(self, t: Table, column: str) -> Column:
        """One column of a table as a triple without its entity; the kind is null where there is no value."""
        value, kind = self._column(t, column)
        has, *rest = payload(value, kind)
        return F.struct(F.lit(f"{t.name}/{column}").alias("a"), F.when(value.isNotNull(), has).alias("kind"), *rest)

    def scan(self, entity: str | None = None, attribute: str | None = None) -> DataFrame:
        """One scan of each table that can hold such triples; a single attribute reads its column and the key."""
        names = [attribute] if attribute is not None else self._attributes()
        if entity is not None:
            names = [a for a in names if a.startswith(entity.partition(":")[0] + "/")]
        by_table: dict[str, list[str]] = {}
        for t, column in filter(None, map(self._known, names)):
            by_table.setdefault(t.name, []).append(column)
        out = None
        for name, columns in by_table.items():
            t, rows = self.tables[name], self.frames[name]
            if entity is not None:
                rows = rows.where(self._key_is(rows, t.key, entity.partition(":")[2]))
            if len(columns) == 1:
                value, kind = self._column(t, columns[0])
                rows = rows.select(self._entity(t).alias("e"), F.lit(f"{name}/{columns[0]}").alias("a"), value.alias("v"))
                rows = rows.where(F.col("v").isNotNull()).select("e", "a", *payload(F.col("v"), kind))
            else:
                rows = rows.select(self._entity(t).alias("e"), F.inline(F.array(*[self._triple(t, c) for c in columns]))).where("kind IS NOT NULL")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.frames[next(iter(self.tables))].sparkSession.createDataFrame([], SCHEMA)

    def star(self, attributes: list[str]) -> DataFrame | None:
        found = [self._known(a) for a in attributes]
        if not all(found) or len({t.name for t, _ in found}) != 1:
            return None
        t = found[0][0]
        out = [self._entity(t).alias("e")]
        for i, (_, column) in enumerate(found):
            value, kind = self._column(t, column)
            has, *rest = payload(value, kind)
            out += [F.when(value.isNotNull(), has).alias(f"kind_{i}"), *(c.alias(f"{n}_{i}") for c, n in zip(rest, ("s", "n", "b", "r"), strict=True))]
        return self.frames[t.name].select(*out)


def explode_wide(source: WideSource) -> DataFrame:
    """All triples of a wide source, as rows to be stored."""
    return source.scan()


def write_triples(df: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder an attribute, sorted by entity, so that attribute scans prune folders and entity scans row groups.

    Ranges of both keys are dealt out, so a common attribute is written by many tasks. form: parquet, orc, json or csv.
    """
    rows = df.repartitionByRange("a", "e").sortWithinPartitions("a", "e")
    rows.write.mode("overwrite").partitionBy("a").options(**_options(form)).format(form).save(path)


def read_triples(spark: SparkSession, path: str, single: bool = True, form: str = "parquet") -> TripleSource:
    return TripleSource(spark.read.schema(SCHEMA).options(**_options(form)).format(form).load(path), single)


def _options(form: str) -> dict[str, str]:
    """In CSV a missing value is told from an empty text by a mark of its own; quotes and line breaks are kept."""
    if form not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unknown format {form!r}")
    return {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""} if form == "csv" else {}


#: The driver's tables as entity types.
TABLES = [
    Table("region", "r_regionkey", {"r_name": "str"}),
    Table("nation", "n_nationkey", {"n_name": "str"}, {"n_regionkey": "region"}),
    Table("customer", "c_custkey", {"c_name": "str", "c_acctbal": "num", "c_mktsegment": "str"}, {"c_nationkey": "nation"}, {"c_acctbal": "c_acctbal >= 0"}),
    Table("supplier", "s_suppkey", {"s_name": "str", "s_acctbal": "num"}, {"s_nationkey": "nation"}, {"s_acctbal": "s_acctbal >= 0"}),
    Table("part", "p_partkey", {"p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "num", "p_retailprice": "num"}),
    Table("orders", "o_orderkey", {"o_orderstatus": "str", "o_totalprice": "num", "o_orderpriority": "str"}, {"o_custkey": "customer"}),
    Table("documents", "doc_id", {"lang": "str", "source": "str", "n_chars": "num"}),
    Table("labels", "doc_id", {"quality": "num", "toxic": "bool"}),
]


def open_tables(spark: SparkSession, sf_dir: str) -> WideSource:
    return WideSource(Frames(spark, sf_dir), TABLES)
