from decimal import Decimal

import pytest

from quillon.functions.predicates import InvalidQuery
from quillon.operators import mvcc
from quillon.plans.query import Query, Var
from quillon.session import Engine
from quillon.sources.store import EngineError

REQ = "request_id long, seq int, arrival long, e string, a string, kind string, s string, n double, b boolean, hlc_p decimal(20,0), hlc_l long, hlc_n long"


def req(spark, rows):
    return spark.createDataFrame([(i, k, j, e, "x/v", "str", s, None, None, Decimal(p), 0, 1) for j, (i, k, e, s, p) in enumerate(rows)], REQ)


def test_a_session(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/data")
    me, you = engine.connect(), engine.connect()
    with pytest.raises(EngineError):
        me.query(Query(["x"]).must(Var("x"), "x/v", Var("v")))
    me.open("app")
    with pytest.raises(EngineError):
        me.open("app")
    you.open("app")
    assert me.store is you.store
    answer = {(r.request_id, r.seq): (r.s, r.error) for r in me.update(req(spark, [(1, 0, "a", "one", 10), (1, 1, "b", "two", 10), (2, 0, "c", "ok", 10), (2, 1, "d", "", 10)])).collect()}
    assert answer == {(1, 0): ("one", None), (1, 1): ("two", None), (2, 1): (None, "string_length")}
    held = me.hold()
    again = {r.seq: r.s for r in you.update(req(spark, [(3, 0, "a", "new", 11), (3, 1, "b", "old", 9)])).collect()}
    assert again == {0: "new", 1: "two"}
    q = Query(["x", "v"]).must(Var("x"), "x/v", Var("v"))
    now = lambda **k: {tuple(r) for r in me.query(q, {"x": "id", "v": "str"}, **k).collect()}
    assert now() == {("a", "new"), ("b", "two")} and now(txn=held) == {("a", "one"), ("b", "two")}
    seen = []
    me.subscribe("s1", lambda batch: seen.extend((r.change_type, r.e) for r in batch.collect()), f"{tmp_path}/cp").awaitTermination()
    assert seen == [("UPDATE", "a")]
    with pytest.raises(InvalidQuery):
        me.subscribe("s1", print, f"{tmp_path}/cp9")
    me.unsubscribe("s1")
    with pytest.raises(InvalidQuery):
        me.unsubscribe("s1")
    me.delete(spark.createDataFrame([("b", "x/v")], "e string, a string"))
    engine.collect_garbage("app")
    assert now(txn=held) == {("a", "one"), ("b", "two")}
    me.release(held)
    engine.collect_garbage("app")
    assert you.store.rows().count() == 1
    me.close()
    with pytest.raises(EngineError):
        me.hold()


def test_checksums_and_strict_updates(spark):
    log = mvcc.with_checksum(spark.createDataFrame([(1, "INSERT", 1.0), (2, "COMMIT", None)], "lsn long, type string, n double"))
    assert mvcc.intact(log).count() == 2
    broken = log.selectExpr("lsn", "type", "if(lsn = 1, 9.0, n) AS n", "crc")
    assert [r.lsn for r in mvcc.intact(broken).collect()] == [2]
    rows = spark.createDataFrame([("a", "x", 1, 0), ("b", "x", 1, 5)], "e string, a string, created_txn long, deleted_txn long")
    mvcc.require_live(rows, rows.where("e = 'a'").select("e", "a"))
    with pytest.raises(mvcc.NotFound):
        mvcc.require_live(rows, rows.select("e", "a"))
    assert mvcc.collect_batch(rows, 1).count() == 1 and mvcc.collect_batch(rows, 1, min_active=3).count() == 2
