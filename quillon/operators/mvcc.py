"""Versions, deletion, garbage collection and recovery from a log.

Every version of a key is kept as [created_txn, deleted_txn); an old snapshot sees the value of its time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import next_of

OPS = ("INSERT", "UPDATE", "DELETE")


class NotFound(KeyError):
    """Delete or strict update of a key without a live row."""


def versions(log: DataFrame, keys: tuple[str, ...] = ("e", "a")) -> DataFrame:
    """Versions from committed operations (lsn, txn, type, keys, payload): the next operation on a key ends a version.

    Of several operations of one transaction on a key the last one counts.
    """
    rest = [c for c in log.columns if c not in (*keys, "txn")]
    last = log.where(F.col("type").isin(*OPS)).groupBy(*keys, "txn").agg(F.max_by(F.struct(*rest), "lsn").alias("w"))
    ops = last.select(*[F.col("w")[c].alias(c) if c in rest else F.col(c) for c in log.columns])
    out = next_of(ops, keys, "lsn", "txn", "__end", log).withColumn("deleted_txn", F.coalesce("__end", F.lit(0).cast("bigint"))).drop("__end").withColumnRenamed("txn", "created_txn")
    return out.where("type <> 'DELETE'").drop("type", "lsn")


def extend(base: DataFrame, log: DataFrame) -> DataFrame:
    """The versions of a base and of the committed operations behind it: the first one on a key ends its live version."""
    firsts = log.where(F.col("type").isin(*OPS)).groupBy("e", "a").agg(F.min("txn").alias("__end"))
    ended = F.when(F.col("deleted_txn") == 0, F.coalesce("__end", F.lit(0).cast("bigint"))).otherwise(F.col("deleted_txn"))
    held = base.join(firsts, ["e", "a"], "left").withColumn("deleted_txn", ended).drop("__end")
    return held.unionByName(versions(log).select(*[c for c in held.columns]))


def committed(log: DataFrame) -> DataFrame:
    """Operations of transactions that have a COMMIT record."""
    done = log.where("type = 'COMMIT'").select("txn").distinct()
    return log.where(F.col("type").isin(*OPS)).join(done, "txn", "left_semi")


def recover(log: DataFrame, base: DataFrame | None = None, checkpoint_lsn: int = -1, keys: tuple[str, ...] = ("e", "a")) -> DataFrame:
    """The live rows after replay: committed operations behind the checkpoint, last one of each key, onto a base."""
    ops = committed(log.where(F.col("lsn") > checkpoint_lsn))
    rest = [c for c in ops.columns if c not in keys]
    last = ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("lsn")).alias("w")).select(*keys, *[F.col("w")[c].alias(c) for c in rest])
    live = last.where("type <> 'DELETE'")
    if base is None:
        return live
    return base.join(last, list(keys), "left_anti").unionByName(live, allowMissingColumns=True)


def delete(rows: DataFrame, keys: DataFrame, txn: int) -> DataFrame:
    """Live versions of the keys end at the transaction; the rows stay until garbage collection."""
    hit = keys.select(F.col("e"), F.col("a"), F.lit(True).alias("__hit")).distinct()
    ended = F.when(F.col("__hit").isNotNull() & (F.col("deleted_txn") == 0), F.lit(txn).cast("bigint")).otherwise(F.col("deleted_txn"))
    return rows.join(hit, ["e", "a"], "left").withColumn("deleted_txn", ended).drop("__hit")


def delete_entity(rows: DataFrame, e: str, txn: int) -> DataFrame:
    ended = F.when((F.col("e") == e) & (F.col("deleted_txn") == 0), F.lit(txn).cast("bigint")).otherwise(F.col("deleted_txn"))
    return rows.withColumn("deleted_txn", ended)


def collectable(min_active: int | None):
    """Whether no snapshot can see a version any more."""
    gone = F.col("deleted_txn") != 0
    return gone if min_active is None else gone & (F.col("deleted_txn") < min_active)


def collect_garbage(rows: DataFrame, min_active: int | None = None) -> DataFrame:
    return rows.where(~collectable(min_active))


def collect_batch(rows: DataFrame, n: int, min_active: int | None = None) -> DataFrame:
    """One tick of incremental collection: without the n collectable versions that were deleted first."""
    oldest = rows.where(collectable(min_active)).orderBy("deleted_txn", "e", "a", "created_txn").limit(n)
    return rows.join(oldest.select("e", "a", "created_txn"), ["e", "a", "created_txn"], "left_anti").select(*rows.columns)


def require_live(rows: DataFrame, keys: DataFrame) -> None:
    """Strict updates and deletions: every key must have a live row."""
    live = rows.where("deleted_txn = 0")
    if missing := keys.join(live, ["e", "a"], "left_anti").limit(1).collect():
        raise NotFound(tuple(missing[0][c] for c in ("e", "a")))


def with_checksum(log: DataFrame) -> DataFrame:
    """Adds crc, over all other columns of a record."""
    cols = [c for c in log.columns if c != "crc"]
    return log.select(*cols, F.crc32(F.to_json(F.struct(*cols)).cast("binary")).alias("crc"))


def intact(log: DataFrame) -> DataFrame:
    """The records whose checksum still fits."""
    cols = [c for c in log.columns if c != "crc"]
    return log.where(F.col("crc") == F.crc32(F.to_json(F.struct(*cols)).cast("binary")))


def garbage_stats(rows: DataFrame, min_active: int | None = None) -> DataFrame:
    """Counts: live, collectable, and deleted but still seen by a snapshot."""
    state = F.when(F.col("deleted_txn") == 0, "live").when(collectable(min_active), "collectable").otherwise("held")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


class Snapshots:
    """The registry of held snapshots: a count for each transaction id."""

    def __init__(self):
        self.held: dict[int, int] = {}

    def acquire(self, txn: int) -> int:
        self.held[txn] = self.held.get(txn, 0) + 1
        return txn

    def release(self, txn: int) -> None:
        if (n := self.held.get(txn, 0)) <= 1:
            self.held.pop(txn, None)
        else:
            self.held[txn] = n - 1

    @property
    def min_active(self) -> int | None:
        return min(self.held, default=None)
