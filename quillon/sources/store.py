"""A versioned store on plain files: each transaction is a folder of operations, published by a mark that names it.

A writer writes to a folder whose name nobody else has, and then makes the mark of its transaction, complete and in one
step that only one writer can win. Readers look at marks alone, so they see all of a commit or nothing; what a refused
or lost writer left behind is never read. Commits append their operations only; a base, the versions as of some
transaction, is written by compaction, and the versions of now are that base with the operations behind it.

One store belongs to one tenant; its name is checked before it becomes a folder.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hlc import Hlc
from ..operators import changes, lww, mvcc, validate
from .triples import COLUMNS, TripleSource

LOG = "lsn bigint, txn bigint, type string, e string, a string, kind string, s string, n double, b boolean, r string, hlc_p decimal(20,0), hlc_l bigint, hlc_n bigint, src_conn bigint"
STATE = "e string, a string, kind string, s string, n double, b boolean, r string, hlc_p decimal(20,0), hlc_l bigint, hlc_n bigint, created_txn bigint, deleted_txn bigint"
MARK = "txn bigint, folder string, kind string, lsn bigint"
#: Commits behind the base after which maintenance writes a new one.
CHECKPOINT_COMMITS = 1000


class EngineError(RuntimeError):
    """A store that can't do what was asked."""


class Store:
    """The rows of all versions, and the log of operations, of one tenant."""

    def __init__(self, spark: SparkSession, root: str, api_key: str):
        if not re.fullmatch(validate.API_KEY.strip("^$"), api_key):
            raise ValueError("an API key has 1 to 256 letters, digits, _ or -")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{api_key}"
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._marks: dict[int, dict] = {}

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    # --- marks ---

    def marks(self) -> list[dict]:
        """All commits in order: txn, folder, kind (ops or base) and the last position so far. Marks never change."""
        if not self._fs.exists(self._at("commits")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("commits"))]
        for txn in (int(x) for x in names if x.isdigit() and int(x) not in self._marks):
            stream = self._fs.open(self._at(f"commits/{txn}"))
            try:
                self._marks[txn] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return [self._marks[t] for t in sorted(self._marks)]

    def _publish(self, mark: dict) -> None:
        """Make a mark: it appears with all it says, and only if there is none of its transaction."""
        lost = EngineError(f"transaction {mark['txn']} was committed by another writer")
        self._fs.mkdirs(self._at("commits"))
        name, text = f"commits/.{mark['folder']}", json.dumps(mark)
        uri = self._fs.makeQualified(self._at(name)).toUri()
        if uri.getScheme() == "file":  # a link is made by one writer only
            with open(uri.getPath(), "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(uri.getPath(), self._at(f"commits/{mark['txn']}").toUri().getPath())
            except FileExistsError:
                raise lost from None
            finally:
                os.unlink(uri.getPath())
            return
        out = self._fs.create(self._at(name), False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:  # a rename that doesn't overwrite is made by one writer only
            jvm.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(self._at(name), self._at(f"commits/{mark['txn']}"), none)
        except Exception as e:
            if self._fs.exists(self._at(f"commits/{mark['txn']}")):
                raise lost from e
            raise

    def _folder(self, txn: int) -> str:
        return f"{txn}-{uuid.uuid4().hex}"

    def _read(self, schema: str, marks: list[dict]) -> DataFrame:
        if not marks:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{m['folder']}" for m in marks])

    # --- reading ---

    def version(self) -> int:
        """The last committed transaction; 0 in an empty store."""
        return max((m["txn"] for m in self.marks()), default=0)

    def rows(self, version: int | None = None) -> DataFrame:
        """All versions of all keys as of a commit: the last base up to it and the operations behind that."""
        marks = [m for m in self.marks() if version is None or m["txn"] <= version]
        base = max((m["txn"] for m in marks if m["kind"] == "base"), default=0)
        held = self._read(STATE, [m for m in marks if m["txn"] == base])
        behind = [m for m in marks if m["txn"] > base]
        return mvcc.extend(held, self._read(LOG, behind)).select(*held.columns) if behind else held

    def log_start(self) -> int:
        """The transaction up to which operations have been given up; 0 if none have."""
        return max((m.get("log_from", 0) for m in self.marks()), default=0)

    def log(self, since_txn: int = 0) -> DataFrame:
        """Operations of committed transactions, those behind a transaction and not given up."""
        start = max(since_txn, self.log_start())
        return self._read(LOG, [m for m in self.marks() if m["kind"] == "ops" and m["txn"] > start])

    def log_stream(self, commits_per_trigger: int | None = None) -> DataFrame:
        """The marks of commits as a stream; operations of a batch of them are read by operations()."""
        self._fs.mkdirs(self._at("commits"))
        reader = self.spark.readStream.schema(MARK)
        if commits_per_trigger is not None:
            reader = reader.option("maxFilesPerTrigger", commits_per_trigger)
        return reader.json(f"{self.path}/commits")

    def operations(self, marks: DataFrame) -> DataFrame:
        """The operations of a batch of marks, which has a row for each commit.

        A reader that comes too late for operations that were given up is told so, and has to start from a snapshot.
        """
        wanted, start = [r.asDict() for r in marks.where("kind = 'ops'").orderBy("txn").collect()], self.log_start()
        if wanted and wanted[0]["txn"] <= start:
            raise EngineError(f"operations up to transaction {start} are gone; start again from a snapshot")
        return self._read(LOG, wanted)

    def source(self, txn: int | None = None) -> TripleSource:
        from ..operators.scans import snapshot

        return TripleSource(snapshot(self.rows(), txn).select(*COLUMNS))

    def changes(self, since: Hlc | None = None, skip_connection: int | None = None) -> DataFrame:
        out = changes.to_changes(self.log())
        out = out if since is None else changes.since_time(out, since)
        return out if skip_connection is None else changes.others(out, skip_connection)

    # --- writing ---

    def _next(self) -> tuple[int, int]:
        """The next transaction and the last position."""
        marks = self.marks()
        return (marks[-1]["txn"] + 1, marks[-1]["lsn"]) if marks else (1, 0)

    def _commit(self, txn: int, ops: DataFrame, last: int) -> int:
        """Write operations and publish them; without any there is no transaction."""
        folder = self._folder(txn)
        ops.write.parquet(f"{self.path}/data/{folder}")
        n, high = self._read(LOG, [{"folder": folder}]).agg(F.count("*"), F.max("lsn")).first()
        if not n:
            self._fs.delete(self._at(f"data/{folder}"), True)
            return txn - 1
        self._publish({"txn": txn, "folder": folder, "kind": "ops", "lsn": max(last, high)})
        return txn

    def upsert(self, updates: DataFrame, src_conn: int = 0) -> int:
        """Merge a validated batch (keys, payload, clock, arrival); older and equal times are left out silently.

        An empty batch, or one without an accepted update, is no transaction. The batch is decided and written once.
        """
        txn, last = self._next()
        first = updates.agg(F.min("arrival")).first()[0]
        if first is None:
            return txn - 1
        decided = lww.decide(updates, self.rows().where("deleted_txn = 0")).where("outcome <> 'reject'")
        # Positions follow the order of arrival and may have gaps, so no task has to number all operations.
        ops = decided.select((F.lit(last + 1 - first) + F.col("arrival")).cast("bigint").alias("lsn"), F.lit(txn).cast("bigint").alias("txn"), F.upper("outcome").alias("type"), "e", "a", *lww.PAYLOAD, *lww.TIME, F.lit(src_conn).cast("bigint").alias("src_conn"))
        return self._commit(txn, ops, last)

    def delete(self, keys: DataFrame, at: Hlc, src_conn: int = 0) -> int:
        """End the live versions of keys; a key without one is an error."""
        txn, last = self._next()
        wanted = keys.select("e", "a").distinct()
        mvcc.require_live(self.rows(), wanted)
        live = self.rows().where("deleted_txn = 0").join(wanted, ["e", "a"], "left_semi")
        none = {"kind": "string", "s": "string", "n": "double", "b": "boolean", "r": "string"}
        ops = live.select((F.lit(last + 1) + F.monotonically_increasing_id()).cast("bigint").alias("lsn"), F.lit(txn).cast("bigint").alias("txn"), F.lit("DELETE").alias("type"), "e", "a", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(at.physical).cast("decimal(20,0)").alias("hlc_p"), F.lit(at.logical).cast("bigint").alias("hlc_l"), F.lit(at.node).cast("bigint").alias("hlc_n"), F.lit(src_conn).cast("bigint").alias("src_conn"))
        return self._commit(txn, ops, last)

    # --- maintenance ---

    def compact(self, min_active: int | None = None, keep_commits: int | None = None) -> int:
        """Checkpoint and garbage collection: a base without versions that no snapshot sees.

        Earlier bases go, but for the one before, which open readers may still hold. The log stays, or its last
        keep_commits commits do; readers that are further behind are told so.
        """
        txn, last = self._next()
        folder = self._folder(txn)
        mvcc.collect_garbage(self.rows(), min_active).write.parquet(f"{self.path}/data/{folder}")
        ops = [m for m in self.marks() if m["kind"] == "ops"]
        given_up = ops[: max(0, len(ops) - keep_commits)] if keep_commits is not None else []
        start = max(self.log_start(), given_up[-1]["txn"] if given_up else 0)
        self._publish({"txn": txn, "folder": folder, "kind": "base", "lsn": last, "log_from": start})
        bases = [m for m in self.marks() if m["kind"] == "base"]
        for old in [*bases[:-2], *(m for m in ops if m["txn"] <= start)]:
            self._fs.delete(self._at(f"data/{old['folder']}"), True)
        return txn

    def maintain(self, min_active: int | None = None, commits: int = CHECKPOINT_COMMITS) -> int | None:
        """Compact if there are so many commits behind the base, else do nothing."""
        marks = self.marks()
        base = max((m["txn"] for m in marks if m["kind"] == "base"), default=0)
        return self.compact(min_active) if sum(m["txn"] > base for m in marks) >= commits else None

    def statistics(self) -> dict[str, int]:
        """Counters of recovery and checkpoints: commits, those that a start has to replay, bases and the last position."""
        marks = self.marks()
        base = max((m["txn"] for m in marks if m["kind"] == "base"), default=0)
        return {"version": self.version(), "last_lsn": marks[-1]["lsn"] if marks else 0, "commits": sum(m["kind"] == "ops" for m in marks), "bases": sum(m["kind"] == "base" for m in marks), "to_replay": sum(m["txn"] > base for m in marks), "checkpoint_txn": base, "log_from": self.log_start()}
