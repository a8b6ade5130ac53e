"""The change feed: log records as changes, since a time or a position, without one's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import Hlc

_PAYLOAD = ("kind", "s", "n", "b", "r")


def to_changes(log: DataFrame) -> DataFrame:
    """Changes from log records; transaction marks drop out, a deletion has no value. Works on streams too."""
    ops = log.where(F.col("type").isin("INSERT", "UPDATE", "DELETE"))
    value = [F.when(F.col("type") != "DELETE", F.col(c)).alias(c) for c in _PAYLOAD if c in log.columns]
    rest = [c for c in log.columns if c not in (*_PAYLOAD, "type")]
    return ops.select(F.col("type").alias("change_type"), *rest, *value)


def at_or_after(since: Hlc) -> Column:
    """Physical and logical time, inclusive; the node is left out."""
    p, logical = F.col("hlc_p"), F.col("hlc_l")
    return (p > since.physical) | ((p == since.physical) & (logical >= since.logical))


def since_time(changes: DataFrame, since: Hlc) -> DataFrame:
    return changes.where(at_or_after(since))


def since_position(log: DataFrame, lsn: int) -> DataFrame:
    """The safe cursor: a late write with an old time has a new position."""
    return log.where(F.col("lsn") >= lsn)


def others(changes: DataFrame, connection: int) -> DataFrame:
    """Without the connection's own writes."""
    return changes.where(~F.col("src_conn").eqNullSafe(F.lit(connection)))


def find_position(log: DataFrame, since: Hlc) -> DataFrame:
    """The first position at or after a time."""
    return log.where(at_or_after(since)).agg(F.min("lsn").alias("lsn"))
