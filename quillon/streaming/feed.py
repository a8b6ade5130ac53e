"""Change feeds and keyed last-write-wins as Structured Streaming queries over file sources.

A log is a folder of Parquet files that commits add to. Reading it as a stream gives every operation once; state of
the last-write-wins operator is one clock a key, so late older writes are rejected and late new keys accepted without
any watermark.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hlc import Hlc
from ..operators.changes import others, since_time, to_changes

# The state function travels with the plan, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

UPDATES = "arrival bigint, e string, a string, kind string, s string, n double, b boolean, r string, hlc_p decimal(20,0), hlc_l bigint, hlc_n bigint"
DECIDED = UPDATES + ", outcome string"


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def live_changes(log: DataFrame, connection: int | None = None, since: Hlc | None = None) -> DataFrame:
    """A subscription: changes of a log stream, from a time on, without one's own. Stateless, so appends flow through."""
    out = to_changes(log)
    out = out if since is None else since_time(out, since)
    return out if connection is None else others(out, connection)


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decide a key's rows at once: the held clock is the running maximum of the clocks' ranks, in order of arrival."""
    held = state.get if state.exists else None
    rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
    first = [[int(x)] for x in held] if held is not None else [[], [], []]
    p, logical, node = (np.concatenate([np.array(x, kind), rows[c].astype(kind).to_numpy()]) for x, c, kind in zip(first, ("hlc_p", "hlc_l", "hlc_n"), (np.uint64, np.int64, np.int64), strict=True))
    order = np.lexsort((node, logical, p))
    new = np.append(False, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (p, logical, node)]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    top = np.maximum.accumulate(rank)
    better = np.append(True, rank[1:] > top[:-1])
    outcome = np.where(better, "update", "reject")
    if held is None:
        outcome[0] = "insert"
    last = int(rank.argmax())
    state.update((Decimal(int(p[last])), int(logical[last]), int(node[last])))
    yield rows.assign(outcome=outcome[len(rank) - len(rows) :])[[c.split(" ")[0] for c in DECIDED.split(", ")]]


def stream_lww(updates: DataFrame) -> DataFrame:
    """Adds outcome to a stream of updates. Rows of a micro-batch have no order of their own: they carry arrival."""
    columns = [c.split(" ")[0] for c in UPDATES.split(", ")]
    return updates.select(*columns).groupBy("e", "a").applyInPandasWithState(_decide, DECIDED, "p decimal(20,0), l bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into a Parquet folder, exactly once by its checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def subscribe(log: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Call back with every micro-batch of changes; several callbacks of a connection share one stream."""
    return log.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def reactive(log: DataFrame, evaluate: Callable[[], DataFrame], each: Callable[[DataFrame], None], checkpoint: str, attributes: list[str] | None = None) -> StreamingQuery:
    """Evaluate a query again whenever a micro-batch touches one of its attributes (or anything)."""

    def run(batch: DataFrame, _: int) -> None:
        touched = batch if attributes is None else batch.where(F.col("a").isin(attributes))
        if touched.limit(1).count():
            each(evaluate())

    return subscribe(log, run, checkpoint)
