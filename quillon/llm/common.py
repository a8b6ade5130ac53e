"""What the operators share: written work tables, safe column names and checked broadcasts."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions that run on executors travel with the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: White space of the word contracts: space and the characters from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Ids above this many rows are joined by a shuffle, below it by a broadcast (8 bytes each).
BROADCAST_IDS = 2_000_000


def process_cache() -> dict:
    """A dictionary that lives as long as a Python worker; functions that travel with plans have no module to keep it."""
    return sys.modules.setdefault("_quillon_cache", types.SimpleNamespace(kept={})).kept


def share(spark: SparkSession, thing: object) -> Broadcast:
    """Broadcast an object of this package's classes, which executors need not have."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def shared(held: Broadcast) -> object:
    """The object of a broadcast made by share, built once in a worker."""
    cache, raw = process_cache(), held.value
    if ("shared", raw) not in cache:
        for key in [k for k in cache if k[0] == "shared"]:
            del cache[key]
        cache["shared", raw] = cloudpickle.loads(raw)
    return cache["shared", raw]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, where they are one process, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = getattr(sc, "_quillon_work", None)
    if found is None:
        found = sc._quillon_work = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return found


class Work:
    """Tables written to the shared folder, so that later plans start from files and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._drop, self.root)

    def _drop(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            pass

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        self._drop(f"{self.root}/{name}")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def columns_but(df: DataFrame, names) -> list[str]:
    """The columns of a table without the named ones; names don't differ by case."""
    out = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in out]


def at(name: str) -> Column:
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(names) -> Column:
    """The named columns as one struct __in, so that an operator's own names can't clash with them."""
    return (F.struct(*map(at, dict.fromkeys(names))) if names else F.struct(F.lit(None).alias("none"))).alias("__in")


def inside(name: str) -> Column:
    """A column of the struct."""
    return F.col("__in").getField(name)


def unpacked(names) -> list[Column]:
    return [inside(c).alias(c) for c in names]


def map_batches(df: DataFrame, names, run, *fields: tuple[str, str]) -> DataFrame:
    """The named columns and new fields, given as (name, type), by Arrow batches.

    run takes batches of the named columns and yields batches of these and the fields, in this order. Columns travel
    under plain names and their types as they are, so no name needs quotes.
    """
    names, new = list(names), [n for n, _ in fields]
    plain = [f"c{i}" for i in range(len(names) + len(new))]
    made = T.StructType([T.StructField(p, df.schema[c].dataType) for p, c in zip(plain, names, strict=False)])
    for p, (_, kind) in zip(plain[len(names) :], fields, strict=True):
        made.add(p, T.DataType.fromDDL(kind))

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain)

    given = df.select(*[at(c).alias(p) for p, c in zip(plain, names, strict=False)])
    return given.mapInArrow(freeing(renamed), made).toDF(*names, *new)


def freeing(run):
    """A function on batches that gives what Arrow holds back to the system at its end; workers outlive their tasks."""

    def all_then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return all_then_free


def pinned(df: DataFrame, *cols) -> DataFrame:
    """A select whose columns are computed once for each row.

    Plain projections are merged, and filters above them pushed below, by copying their expressions to wherever they
    are used, even into lambdas, which then do them again for each element. A generator of one row stops that.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))


def lower_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join on one key (null matches nothing) whose sides are always dealt out anew, so that adaptive execution can split a hot key.

    An aggregate on the same key would otherwise lend its partitioning to the join, and then no part can be split.
    The extra key is a function of the first and changes no result.
    """
    left = left.withColumn("__deal", F.xxhash64(key))
    right = right.withColumn("__deal", F.xxhash64(key))
    return left.join(right, [key, "__deal"], how).drop("__deal")


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str, n_ids: int) -> DataFrame:
    """Semi or anti join with an id table of known size: broadcast up to BROADCAST_IDS rows, else by a shuffle."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, how)
