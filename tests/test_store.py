import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.functions import hlc, ids
from quillon.operators import changes, lww, mvcc, validate
from quillon.sources.store import Store
from quillon.streaming import feed

U = feed.UPDATES


def upd(arrival, e, n, p, logical=0, node=0, a="x/v"):
    return (arrival, e, a, "num", None, float(n), None, None, Decimal(p), logical, node)


def frame(spark, rows):
    return spark.createDataFrame(rows, U)


@pytest.mark.parametrize("new,outcome", [((11, 0, 0), "update"), ((9, 9, 9), "reject"), ((10, 6, 0), "update"), ((10, 4, 9), "reject"), ((10, 5, 8), "update"), ((10, 5, 6), "reject"), ((10, 5, 7), "reject"), ((2**64 - 1, 0, 0), "update")])
def test_clock_components(spark, new, outcome):
    rows = lww.decide(frame(spark, [upd(0, "k", 1, 10, 5, 7), upd(1, "k", 2, *new)])).orderBy("arrival").collect()
    assert [r.outcome for r in rows] == ["insert", outcome]


def test_any_order_gives_one_state(spark):
    rows = [("a", 1, 5), ("a", 2, 7), ("a", 3, 6), ("b", 4, 1)]
    for order in itertools.islice(itertools.permutations(rows), 6):
        state = lww.latest(frame(spark, [upd(i, *r) for i, r in enumerate(order)]))
        assert {r.e: r.n for r in state.collect()} == {"a": 2.0, "b": 4.0}


def test_first_of_equal_times_stays(spark):
    assert lww.latest(frame(spark, [upd(1, "a", 2, 5), upd(0, "a", 1, 5)])).first().n == 1.0


def test_list_order_takes_the_last_accepted(spark):
    held = frame(spark, [upd(0, "a", 1, 5)])
    got = lww.decide_at_once(frame(spark, [upd(1, "a", 2, 9), upd(2, "a", 3, 7), upd(3, "a", 4, 4)]), held).orderBy("arrival").collect()
    assert [(r.outcome, r.last) for r in got] == [("update", False), ("update", True), ("reject", False)]


def test_store_commits_versions_and_feeds(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}", "app-1")
    assert s.version() == 0 and s.rows().count() == 0 and s.log().count() == 0
    assert s.upsert(frame(spark, [])) == 0
    assert s.upsert(frame(spark, [upd(0, "a", 1, 10), upd(1, "b", 2, 10)]), src_conn=1) == 1
    assert s.upsert(frame(spark, [upd(0, "a", 5, 20), upd(1, "b", 9, 3)]), src_conn=2) == 2
    assert s.upsert(frame(spark, [upd(0, "a", 7, 1)])) == 2  # nothing accepted
    live = lambda txn=None: {r.e: r.n for r in s.source(txn).scan().collect()}
    assert live() == {"a": 5.0, "b": 2.0} and live(1) == {"a": 1.0, "b": 2.0}
    assert [(r.change_type, r.e) for r in s.changes().orderBy("lsn").collect()] == [("INSERT", "a"), ("INSERT", "b"), ("UPDATE", "a")]
    assert [r.e for r in s.changes(hlc.Hlc(20), skip_connection=1).collect()] == ["a"]
    s.delete(spark.createDataFrame([("b", "x/v")], "e string, a string"), hlc.Hlc(30))
    assert live() == {"a": 5.0} and live(2) == {"a": 5.0, "b": 2.0}
    with pytest.raises(mvcc.NotFound):
        s.delete(spark.createDataFrame([("zz", "x/v")], "e string, a string"), hlc.Hlc(31))
    last = s.changes().orderBy(F.desc("lsn")).first()
    assert last.change_type == "DELETE" and last.n is None
    s.compact(min_active=3)
    assert s.rows().count() == 2 and live() == {"a": 5.0}
    again = Store(spark, f"file://{tmp_path}", "app-1")
    assert again.version() == s.version()
    assert Store(spark, f"file://{tmp_path}", "app-2").version() == 0


@pytest.mark.parametrize("key", ["", "a/b", "..", "x" * 257, "a b"])
def test_api_keys(spark, tmp_path, key):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), key)


def test_validation(spark):
    ok = b"0123456789abcdef"
    rows = [(1, 0, ok, ok, "str", "x", 1, 0, 0), (1, 1, ok, ok, "str", "", 1, 0, 0), (2, 0, b"short", ok, "num", None, 1, 0, 0), (3, 0, ok, ok, None, None, None, 0, 0), (4, 0, ok, ok, "str", "é" * 513, 1, 0, 0), (5, 0, ok, ok, "str", "é" * 512, 1, 0, 0), (None, 0, ok, None, "bool", None, 1, 0, 0), (6, 0, ok, ok, "null", None, 1, 0, 0)]
    got = validate.validate(spark.createDataFrame(rows, "request_id long, seq int, e binary, a binary, kind string, s string, hlc_p long, hlc_l long, hlc_n long"))
    seen = {(r.request_id, r.seq): (r.errors, r.request_ok) for r in got.collect()}
    assert seen[1, 0] == ([], False) and seen[1, 1] == (["string_length"], False)
    assert seen[2, 0] == (["entity_id"], False) and seen[3, 0] == (["value", "hlc"], False)
    assert seen[4, 0] == (["string_length"], False) and seen[5, 0] == ([], True)
    assert seen[None, 0] == (["request_id", "attribute_id"], False) and seen[6, 0] == (["value"], False)
    assert {(r.request_id, r.error) for r in validate.first_error(got).collect()} >= {(1, "string_length"), (3, "value")}


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "lsn long, txn long, type string, e string, a string, n double")


def test_recovery(spark):
    log = log_rows(spark, [(1, 1, "BEGIN", None, None, None), (2, 1, "INSERT", "k", "a", 1.0), (3, 2, "BEGIN", None, None, None), (4, 2, "INSERT", "lost", "a", 9.0), (5, 1, "COMMIT", None, None, None), (6, 3, "UPDATE", "k", "a", 2.0), (7, 3, "INSERT", "g", "a", 3.0), (8, 3, "DELETE", "g", "a", None), (9, 3, "COMMIT", None, None, None)])
    assert [(r.e, r.n) for r in mvcc.recover(log).collect()] == [("k", 2.0)]
    base = spark.createDataFrame([("k", "a", 1.0), ("old", "a", 7.0)], "e string, a string, n double")
    assert sorted((r.e, r.n) for r in mvcc.recover(log, base, checkpoint_lsn=5).collect()) == [("k", 2.0), ("old", 7.0)]


def test_versions_and_garbage(spark):
    log = log_rows(spark, [(1, 1, "INSERT", "k", "a", 1.0), (2, 2, "UPDATE", "k", "a", 2.0), (3, 4, "DELETE", "k", "a", None), (4, 5, "INSERT", "k", "a", 3.0)])
    v = mvcc.versions(log)
    assert sorted((r.created_txn, r.deleted_txn, r.n) for r in v.collect()) == [(1, 2, 1.0), (2, 4, 2.0), (5, 0, 3.0)]
    assert mvcc.collect_garbage(v, 3).count() == 2 and mvcc.collect_garbage(v).count() == 1
    held = mvcc.Snapshots()
    held.acquire(4), held.acquire(4), held.acquire(7)
    held.release(4)
    assert held.min_active == 4
    held.release(4)
    assert held.min_active == 7


def test_clock():
    now = [1000]
    c = hlc.Clock(3, lambda: now[0])
    assert c.tick() == hlc.Hlc(1000, 0, 3) and c.tick() == hlc.Hlc(1000, 1, 3)
    now[0] = 900
    assert c.tick() == hlc.Hlc(1000, 2, 3)
    assert c.receive(hlc.Hlc(1000, 9, 1)) == hlc.Hlc(1000, 10, 3)
    assert c.receive(hlc.Hlc(1500, 4, 1)) == hlc.Hlc(1500, 5, 3)
    now[0] = 2000
    assert c.receive(hlc.Hlc(1500, 4, 1)) == hlc.Hlc(2000, 0, 3)
    with pytest.raises(hlc.ClockDrift):
        c.receive(hlc.Hlc(2000 + 60_001))


def test_ids(spark):
    assert ids.id_from_text("ab") == b"ab" + bytes(14) and len(ids.id_from_text("x" * 40)) == 16
    assert ids.id_from_number(258) == b"\x02\x01" + bytes(14)
    assert ids.attribute_id("name", "users") == ids.attribute_id("users/name") and len(ids.attribute_id("users/name")) == 16
    assert ids.attribute_id("0x" + "0f" * 16) == b"\x0f" * 16
    with pytest.raises(ValueError):
        ids.attribute_id("name")
    df = spark.createDataFrame([(bytearray(b"ab" + bytes(14)),), (bytearray(b"\xff" * 16),), (bytearray("é".encode() + bytes(14)),)], "b binary")
    assert [r[0] for r in df.select(ids.show_id(F.col("b"))).collect()] == ["ab", "ff" * 16, "é"]
    assert bytes(spark.range(1).select(ids.id_column(F.lit("ab"))).first()[0]) == ids.id_from_text("ab")


def test_streams(spark, tmp_path):
    rnd = random.Random(4)
    rows = [upd(i, f"k{rnd.randrange(4)}", i, rnd.randrange(20)) for i in range(60)]
    for part in range(3):
        frame(spark, rows[part * 20 : part * 20 + 20]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = feed.read_log(spark, f"{tmp_path}/in", U, 1)
    seen = []
    q = feed.subscribe(stream, lambda batch, _: seen.append(batch.count()), f"{tmp_path}/cp2")
    q.awaitTermination()
    assert sum(seen) == 60
    feed.drain(feed.stream_lww(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.arrival: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 60
    firsts = {}
    for a in sorted(got):
        firsts.setdefault(rows[a][1], got[a])
    assert set(firsts.values()) == {"insert"} or len(seen) > 1


def test_change_conversion(spark):
    log = spark.createDataFrame([(1, 1, "BEGIN", None, None, None, None), (2, 1, "INSERT", "e", "a", 1.0, 7), (3, 1, "DELETE", "e", "a", 1.0, 8), (4, 1, "CHECKPOINT", None, None, None, None)], "lsn long, txn long, type string, e string, a string, n double, src_conn long")
    got = changes.to_changes(log).orderBy("lsn").collect()
    assert [(r.change_type, r.n) for r in got] == [("INSERT", 1.0), ("DELETE", None)]
    assert changes.others(changes.to_changes(log), 7).count() == 1
