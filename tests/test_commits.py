"""Commits of several writers: one wins, the others are refused and leave nothing to read or hear."""

import threading
from decimal import Decimal

import pytest

from quillon.session import Engine
from quillon.sources.store import EngineError, Store
from quillon.streaming import feed

U = feed.UPDATES


def upd(spark, rows):
    return spark.createDataFrame([(i, e, "x/v", "str", s, None, None, None, Decimal(p), 0, 0) for i, (e, s, p) in enumerate(rows)], U)


def live(store, txn=None):
    return {r.e: r.s for r in store.source(txn).scan().collect()}


def test_interleaved_writers(spark, tmp_path):
    """A commits between what B read and what B publishes: B is refused, A's value stays."""
    a, b = (Store(spark, f"file://{tmp_path}", "app") for _ in range(2))
    a.upsert(upd(spark, [("k", "first", 1)]))
    publish = b._publish

    def late(mark):
        assert a.upsert(upd(spark, [("k", "from A", 5)])) == 2
        publish(mark)

    b._publish = late
    with pytest.raises(EngineError, match="another writer"):
        b.upsert(upd(spark, [("k", "from B", 9), ("only B", "x", 9)]))
    b._publish = publish
    assert live(a) == live(b) == {"k": "from A"} and a.version() == 2
    assert [(r.change_type, r.s) for r in b.changes().orderBy("lsn").collect()] == [("INSERT", "first"), ("UPDATE", "from A")]
    assert b.upsert(upd(spark, [("k", "from B", 9)])) == 3 and live(a) == {"k": "from B"} and live(a, 2) == {"k": "from A"}


def test_a_lost_writer_leaves_nothing_to_read_or_hear(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/data")
    me, you = engine.connect().open("app"), engine.connect().open("app")
    you.store.upsert(upd(spark, [("k", "one", 1)]), you.number)
    lost = Store(spark, f"file://{tmp_path}/data", "app")
    lost._publish = lambda mark: (_ for _ in ()).throw(ConnectionError("lost"))
    with pytest.raises(ConnectionError):
        lost.upsert(upd(spark, [("k", "never", 7), ("z", "never", 7)]))
    seen = []
    hear = lambda batch: seen.extend((r.change_type, r.s) for r in batch.collect())
    me.subscribe("s", hear, f"{tmp_path}/cp").awaitTermination()
    assert seen == [("INSERT", "one")] and live(you.store) == {"k": "one"}
    me.unsubscribe("s")
    you.store.upsert(upd(spark, [("k", "two", 8)]), you.number)
    me.store.upsert(upd(spark, [("k", "mine", 9)]), me.number)
    me.subscribe("s", hear, f"{tmp_path}/cp").awaitTermination()
    assert seen == [("INSERT", "one"), ("UPDATE", "two")]


def test_racing_writers(spark, tmp_path):
    """Eight threads publish the same transaction: one succeeds."""
    stores = [Store(spark, f"file://{tmp_path}", "app") for _ in range(8)]
    won, refused = [], []

    def go(s, k):
        try:
            s._publish({"txn": 1, "folder": f"f{k}", "kind": "ops", "lsn": 1})
            won.append(k)
        except EngineError:
            refused.append(k)

    threads = [threading.Thread(target=go, args=(s, k)) for k, s in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(refused) == 7
    assert [m["folder"] for m in stores[0].marks()] == [f"f{won[0]}"]


def test_a_rename_that_does_not_overwrite(spark, tmp_path):
    """The way of file systems other than a local one."""
    s = Store(spark, f"file://{tmp_path}", "app")
    real = s._fs
    s._fs.mkdirs(s._at("commits"))
    jvm = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    (tmp_path / "app/commits/.a").write_text("a")
    (tmp_path / "app/commits/.b").write_text("b")
    context = jvm.FileContext.getFileContext(real.makeQualified(s._at("commits")).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(s._at("commits/.a"), s._at("commits/1"), none)
    with pytest.raises(Exception, match="FileAlreadyExists"):
        context.rename(s._at("commits/.b"), s._at("commits/1"), none)
    assert (tmp_path / "app/commits/1").read_text() == "a"


def test_bases_and_operations_give_the_same_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "app")
    versions = lambda store: sorted((r.e, r.s, r.created_txn, r.deleted_txn) for r in store.rows().collect())
    s.upsert(upd(spark, [("a", "1", 1), ("b", "1", 1), ("a", "2", 2)]))
    s.upsert(upd(spark, [("a", "3", 3)]))
    want = [("a", "2", 1, 2), ("a", "3", 2, 0), ("b", "1", 1, 0)]
    assert versions(s) == want and s.statistics()["to_replay"] == 2
    assert s.maintain(commits=9) is None and s.maintain(min_active=1, commits=2) == 3
    assert versions(s) == want and s.statistics() == {"version": 3, "last_lsn": s.statistics()["last_lsn"], "commits": 2, "bases": 1, "to_replay": 0, "checkpoint_txn": 3, "log_from": 0}
    s.upsert(upd(spark, [("b", "2", 9), ("c", "1", 9)]))
    assert versions(s) == [("a", "2", 1, 2), ("a", "3", 2, 0), ("b", "1", 1, 4), ("b", "2", 4, 0), ("c", "1", 4, 0)]
    for _ in range(3):
        s.compact()
    assert versions(s) == [("a", "3", 2, 0), ("b", "2", 4, 0), ("c", "1", 4, 0)]
    assert len(list((tmp_path / "app/data").iterdir())) == 3 + 2  # all operations, two bases
    assert [r.lsn for r in s.log().orderBy("lsn").collect()] == sorted({r.lsn for r in s.log().collect()})


def test_a_log_that_is_cut(spark, tmp_path):
    """The last commits stay; a listener that is further behind is told so, a new one starts with what is there."""
    engine = Engine(spark, f"file://{tmp_path}/data")
    me, you = engine.connect().open("app"), engine.connect().open("app")
    for k in range(4):
        you.store.upsert(upd(spark, [("k", str(k), k + 1)]), you.number)
    assert you.store.compact(keep_commits=2) == 5 and you.store.log_start() == 2
    assert [r.s for r in you.store.log().orderBy("lsn").collect()] == ["2", "3"] and live(me.store) == {"k": "3"}
    with pytest.raises(EngineError, match="snapshot"):
        me.store.operations(spark.createDataFrame([(2, "x", "ops", 1)], "txn long, folder string, kind string, lsn long"))
    you.store.upsert(upd(spark, [("k", "4", 9)]), you.number)
    assert live(me.store) == {"k": "4"} and [r.s for r in you.store.log(4).collect()] == ["4"]
    assert you.store.compact(keep_commits=0) == 7 and you.store.log().count() == 0 and live(me.store) == {"k": "4"}


def test_background_maintenance(spark, tmp_path):
    import time

    engine = Engine(spark, f"file://{tmp_path}")
    store = engine.connect().open("app").store
    store.upsert(upd(spark, [("a", "1", 1)]))
    engine.start_maintenance(0.05, commits=1)
    with pytest.raises(EngineError):
        engine.start_maintenance(1)
    for _ in range(200):
        if store.statistics()["bases"]:
            break
        time.sleep(0.1)
    engine.stop_maintenance()
    assert store.statistics()["bases"] >= 1 and live(store) == {"a": "1"}
