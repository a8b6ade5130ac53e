"""Scans, counts and membership over versioned triples.

Rows have e, a, a payload, created_txn and deleted_txn (0: live). All are filters or partial aggregates, which reach
the file scan; a store partitioned by attribute prunes folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(txn: int | None = None) -> Column:
    """The version a snapshot sees; without one, what is live now."""
    if txn is None:
        return F.col("deleted_txn") == 0
    return (F.col("created_txn") <= txn) & ((F.col("deleted_txn") == 0) | (F.col("deleted_txn") > txn))


def snapshot(rows: DataFrame, txn: int | None = None) -> DataFrame:
    return rows.where(visible(txn))


def point(rows: DataFrame, e: str, a: str) -> DataFrame:
    return rows.where((F.col("e") == e) & (F.col("a") == a))


def entity(rows: DataFrame, e: str) -> DataFrame:
    return rows.where(F.col("e") == e)


def attribute(rows: DataFrame, a: str) -> DataFrame:
    return rows.where(F.col("a") == a)


def entities_with(rows: DataFrame, a: str) -> DataFrame:
    return attribute(rows, a).select("e").distinct()


def attributes_of(rows: DataFrame, e: str) -> DataFrame:
    return entity(rows, e).select("a").distinct()


def in_key_order(rows: DataFrame, start: tuple[str, str] | None = None) -> DataFrame:
    """All rows by entity and attribute, from a key on if one is given; a range partitioned sort."""
    if start is not None:
        rows = rows.where(F.struct("e", "a") >= F.struct(F.lit(start[0]).alias("e"), F.lit(start[1]).alias("a")))
    return rows.orderBy("e", "a")


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def members(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The (e, a) keys that have a row."""
    return keys.join(rows.select("e", "a"), ["e", "a"], "left_semi")
