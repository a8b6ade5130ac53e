"""Field-level last-write-wins, ordered by hybrid logical clocks.

An update is accepted if its time is strictly greater than the stored one. With times t1, t2, ... of a key in order of
arrival the stored time is their running maximum, taken over slices of the arrivals so that a hot key is spread; the
state after a batch is one aggregate that combines on the map side. Of equal times the first to arrive stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hlc import stamp
from .slices import max_before

KEY = ("e", "a")
PAYLOAD = ("kind", "s", "n", "b", "r")
TIME = ("hlc_p", "hlc_l", "hlc_n")


def latest(updates: DataFrame, keys: tuple[str, ...] = KEY, arrival: str = "arrival") -> DataFrame:
    """The winning update of each key: the greatest time, then the first to arrive. No window, no skew: one max."""
    rest = [c for c in updates.columns if c not in keys]
    order = F.struct(stamp().alias("t"), (-F.col(arrival)).alias("first"))
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w"))
    return best.select(*keys, *[F.col("w")[c].alias(c) for c in rest])


def decide(updates: DataFrame, stored: DataFrame | None = None, keys: tuple[str, ...] = KEY, arrival: str = "arrival") -> DataFrame:
    """Adds outcome: insert, update or reject, for updates in order of arrival onto a stored state.

    stored has the keys and the clock columns of live rows.
    """
    d = max_before(updates.withColumn("__t", stamp()), keys, arrival, "__t", "__top")
    if stored is not None:
        held = stored.select(*keys, stamp().alias("__held"))
        d = d.join(held, list(keys), "left").withColumn("__top", F.greatest("__held", "__top"))
    outcome = F.when(F.col("__top").isNull(), "insert").when(F.col("__t") > F.col("__top"), "update").otherwise("reject")
    return d.withColumn("outcome", outcome).drop("__t", "__held", "__top")


def decide_at_once(updates: DataFrame, stored: DataFrame, keys: tuple[str, ...] = KEY, arrival: str = "arrival") -> DataFrame:
    """List-order batches: every update is held against the state before the batch, and the last accepted one wins.

    Adds outcome, and last (whether it is the one that stays).
    """
    held = stored.select(*keys, stamp().alias("__held"))
    d = updates.join(held, list(keys), "left")
    outcome = F.when(F.col("__held").isNull(), "insert").when(stamp() > F.col("__held"), "update").otherwise("reject")
    d = d.withColumn("outcome", outcome).drop("__held")
    final = d.where("outcome <> 'reject'").groupBy(*keys).agg(F.max(arrival).alias("__final"))
    return d.join(final, list(keys), "left").withColumn("last", F.coalesce(F.col(arrival) == F.col("__final"), F.lit(False))).drop("__final")


def merge(stored: DataFrame, updates: DataFrame, keys: tuple[str, ...] = KEY, arrival: str = "arrival") -> DataFrame:
    """The state after a batch: stored rows and updates, the latest of each key. Stored rows arrived first."""
    cols = [c for c in updates.columns if c != arrival]
    both = stored.select(*cols, F.lit(-1).cast("bigint").alias(arrival)).unionByName(updates.select(*cols, F.col(arrival).cast("bigint").alias(arrival)))
    return latest(both, keys, arrival).drop(arrival)


def respond(updates: DataFrame, state: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The current row of every requested key, as often as it was requested."""
    return updates.select("request_id", "seq", *keys).join(state, list(keys), "left")
