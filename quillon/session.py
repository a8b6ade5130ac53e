"""Sessions: one store a tenant, connections to it, and what a connection may do.

A connection is opened once, before anything else; its subscriptions have ids of their own; it doesn't hear its own
writes while it listens.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .auth import AuthError, Verifier
from .functions.hlc import Clock, Hlc
from .functions.predicates import InvalidQuery
from .operators import lww, validate
from .operators.mvcc import Snapshots
from .plans.compile import Modes, run
from .plans.query import Query
from .sources.store import CHECKPOINT_COMMITS, EngineError, Store
from .sources.triples import COLUMNS, TripleSource
from .streaming import feed


class Engine:
    """All stores below one folder; a store is opened when it is first asked for and shared by its connections."""

    def __init__(self, spark: SparkSession, root: str, verifier: Verifier | None = None):
        self.spark, self.root, self.verifier = spark, root, verifier
        self.stores: dict[str, Store] = {}
        self.snapshots: dict[str, Snapshots] = {}
        self._next = 0
        self._stop: threading.Event | None = None

    def store(self, api_key: str) -> Store:
        if api_key not in self.stores:
            self.stores[api_key] = Store(self.spark, self.root, api_key)
            self.snapshots[api_key] = Snapshots()
        return self.stores[api_key]

    def connect(self) -> Connection:
        self._next += 1
        return Connection(self, self._next)

    def collect_garbage(self, api_key: str) -> int:
        """A new version without what no held snapshot sees."""
        store = self.store(api_key)
        return store.compact(self.snapshots[api_key].min_active)

    def maintain(self, commits: int = CHECKPOINT_COMMITS) -> dict[str, int | None]:
        """One tick of upkeep: checkpoint every open store that has enough commits behind its base.

        A store to which somebody else commits meanwhile is left for the next tick.
        """
        done: dict[str, int | None] = {}
        for key, store in list(self.stores.items()):
            try:
                done[key] = store.maintain(self.snapshots[key].min_active, commits)
            except EngineError:
                done[key] = None
        return done

    def start_maintenance(self, seconds: float, commits: int = CHECKPOINT_COMMITS) -> None:
        """Tick in the background until stop_maintenance."""
        if self._stop is not None:
            raise EngineError("maintenance runs already")
        stop = self._stop = threading.Event()

        def loop() -> None:
            while not stop.wait(seconds):
                self.maintain(commits)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop_maintenance(self) -> None:
        if self._stop is not None:
            self._stop.set()
            self._thread.join()
            self._stop = None


def union_sources(*sources: TripleSource) -> TripleSource:
    """Several stores as one, such as a shared and a user's own; single only if no key can be in two of them."""
    df = sources[0].scan()
    for s in sources[1:]:
        df = df.unionByName(s.scan())
    return TripleSource(df.select(*COLUMNS), single=len(sources) == 1 and sources[0].single)


class Connection:
    """One client's view of a store."""

    def __init__(self, engine: Engine, number: int):
        self.engine, self.number = engine, number
        self.clock = Clock(number)
        self._store: Store | None = None
        self.api_key = ""
        self.user: str | None = None
        self.subscriptions: dict[str, StreamingQuery] = {}

    def open(self, api_key: str, token: str | None = None) -> Connection:
        """Open the store of an API key; where users sign in, a token is needed, and its subject becomes the user."""
        if self._store is not None:
            raise EngineError("the connection is open already")
        if self.engine.verifier is not None:
            if token is None:
                raise AuthError("a token is needed")
            self.user = self.engine.verifier.user(token)
        self._store, self.api_key = self.engine.store(api_key), api_key
        return self

    @property
    def store(self) -> Store:
        if self._store is None:
            raise EngineError("open the connection first")
        return self._store

    def query(self, query: Query, types: dict[str, str] | None = None, modes: Modes = Modes(), txn: int | None = None) -> DataFrame:
        return run(self.store.source(txn), query, types, modes)

    def hold(self) -> int:
        """A snapshot that garbage collection spares until it is released."""
        return self.engine.snapshots[self.api_key].acquire(self.store.version())

    def release(self, txn: int) -> None:
        self.engine.snapshots[self.api_key].release(txn)

    def update(self, requests: DataFrame) -> DataFrame:
        """Apply requests (request_id, seq, arrival, keys, payload, clock) and answer each with its keys' current rows.

        A request with a bad triple fails as a whole: its rows come back with the first error, nothing of it is stored.
        """
        store = self.store
        checked = validate.validate(requests, binary_ids=False)
        good = checked.where("request_ok").select(*requests.columns)
        if "r" not in good.columns:
            good = good.withColumn("r", F.lit(None).cast("string"))
        columns = ["arrival", "e", "a", *lww.PAYLOAD, *lww.TIME]
        store.upsert(good.select(*columns), self.number)
        state = store.rows().where("deleted_txn = 0").select("e", "a", *lww.PAYLOAD, *lww.TIME)
        done = lww.respond(good.select("request_id", "seq", "e", "a"), state).withColumn("error", F.lit(None).cast("string"))
        return done.unionByName(validate.first_error(checked), allowMissingColumns=True)

    def delete(self, keys: DataFrame) -> int:
        return self.store.delete(keys, self.clock.tick(), self.number)

    def subscribe(self, id: str, each: Callable[[DataFrame], None], checkpoint: str, since: Hlc | None = None) -> StreamingQuery:
        """Changes that are there, from a time on, and those that come, by others; the id is the connection's own.

        The stream is of commits, so operations of refused or lost writers are never heard.
        """
        if id in self.subscriptions:
            raise InvalidQuery(f"there is a subscription {id!r} already")
        store, number = self.store, self.number

        def deliver(marks: DataFrame, _: int) -> None:
            each(feed.live_changes(store.operations(marks), number, since))

        self.subscriptions[id] = feed.subscribe(store.log_stream(), deliver, checkpoint)
        return self.subscriptions[id]

    def unsubscribe(self, id: str) -> None:
        if id not in self.subscriptions:
            raise InvalidQuery(f"there is no subscription {id!r}")
        self.subscriptions.pop(id).stop()

    def close(self) -> None:
        for id in list(self.subscriptions):
            self.unsubscribe(id)
        self._store = None
