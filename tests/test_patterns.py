"""Pattern queries against the nested-loop evaluator, by hand-made cases and random ones."""

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from oracle import evaluate
from quillon.functions.predicates import InvalidQuery
from quillon.functions.values import Entity, Ref
from quillon.plans.compile import Modes, run
from quillon.plans.query import Pattern, Query, Var
from quillon.sources.triples import SCHEMA, TripleSource

V = Var


def row(e, a, v):
    kind, x = v
    return (e, a, kind, x if kind == "str" else None, x if kind == "num" else None, x if kind == "bool" else None, x if kind == "ref" else None)


def source(spark, triples, single=True):
    return TripleSource(spark.createDataFrame([row(*t) for t in triples], SCHEMA), single)


def shown(x):
    if x is None:
        return None
    kind, v = x
    marks = {"entity": "#{}", "ref": "#{}", "field": ":{}", "str": '"{}"', "bool": "{}", "null": "null"}
    return repr(float(v)) if kind == "num" else marks[kind].format(str(v).lower() if kind == "bool" else v)


def check(spark, triples, query, modes=Modes(), single=True):
    got = Counter(tuple(r) for r in run(source(spark, triples, single), query, modes=modes).collect())
    assert got == Counter(tuple(map(shown, r)) for r in evaluate(triples, query))
    return got


USERS = [
    ("u1", "name", ("str", "Ann")), ("u1", "age", ("num", 30.0)), ("u1", "active", ("bool", True)),
    ("u2", "name", ("str", "Bob")), ("u2", "age", ("num", 25.0)), ("u2", "active", ("bool", False)),
    ("u3", "name", ("str", "Cem")), ("u3", "boss", ("ref", "u1")), ("u1", "boss", ("ref", "u1")), ("u2", "boss", ("ref", "u3")),
]


@pytest.mark.parametrize(
    "query",
    [
        Query(["x", "n"]).must(V("x"), "name", V("n")),
        Query(["x", "n", "g"]).must(V("x"), "name", V("n")).must(V("x"), "age", V("g")),
        Query(["x", "g"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("g")),
        Query(["x"]).must(V("x"), "name", V("n")).must_not(V("x"), "age", V("g")),
        Query(["x"]).must(V("x"), "name", V("n")).must_not(V("x"), "active", False),
        Query(["x"]).must(V("x"), "name", V("n")).must_not(V("x"), "active", True).must_not(V("x"), "boss", V("y")),
        Query(["x"]).must(V("x"), "name", V("n")).must_not_all((V("x"), "boss", V("y")), (V("y"), "active", True)),
        Query(["x", "bn"]).must(V("x"), "boss", V("y")).must(V("y"), "name", V("bn")),
        Query(["y", "x"]).must(V("y"), "name", V("n")).must(V("x"), "boss", V("y")),
        Query(["x"]).must(V("x"), "boss", V("x")),
        Query(["x"]).must(V("x"), V("x"), V("v")),
        Query(["a", "v"]).must("u1", V("a"), V("v")),
        Query(["x", "a"]).must(V("x"), V("a"), Ref("u1")),
        Query(["x", "a"]).must(V("x"), V("a"), Entity("u1")),
        Query(["x", "y"]).must(V("x"), "age", V("g")).must(V("y"), "active", V("b")),
        Query(["x"]).must("u1", "name", "Ann").must(V("x"), "age", V("g")),
        Query(["x"]).must("u1", "name", "Nobody").must(V("x"), "age", V("g")),
        Query(["x", "v"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("v")).may(V("x"), "boss", V("v")),
        Query(["x", "v"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("v")).must_not(V("y"), "age", V("v")),
        Query(["x", "v"]).may(V("x"), "age", V("v")),
        Query(["x"]).must(V("x"), "name", V("n")).must_not("u1", "name", "Ann"),
        Query(["x"]).must(V("x"), "name", V("n")).must_not("u1", "name", "Zed"),
    ],
)
@pytest.mark.parametrize("fuse", [True, False])
def test_hand_made(spark, query, fuse):
    check(spark, USERS, query, Modes(fuse_stars=fuse))


ids, attributes = st.sampled_from(["a", "b", "c"]), st.sampled_from(["p", "q", "r"])
values = st.one_of(ids.map(lambda x: ("ref", x)), st.sampled_from(["a", "s"]).map(lambda x: ("str", x)), st.sampled_from([0.0, 1.0, 2.5]).map(lambda x: ("num", x)), st.booleans().map(lambda x: ("bool", x)))
variables = st.sampled_from(["x", "y", "z", "w"]).map(Var)
patterns = st.builds(Pattern, st.one_of(variables, ids), st.one_of(variables, attributes), st.one_of(variables, st.sampled_from(["a", "s", 1.0, True]), ids.map(Ref)))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(ids, attributes), values, min_size=1, max_size=7), st.lists(patterns, min_size=1, max_size=3), st.lists(patterns, max_size=2), st.lists(st.lists(patterns, min_size=1, max_size=2), max_size=1))
def test_random(spark, triples, where, optional, where_not):
    data = [(e, a, v) for (e, a), v in triples.items()]
    query = Query(["x", "y", "z", "w"], where, list(dict.fromkeys(optional)), where_not)
    check(spark, data, query)


def test_strict_references_do_not_stand_for_entities(spark):
    q = Query(["bn"]).must(V("x"), "boss", V("y")).must(V("y"), "name", V("bn"))
    assert run(source(spark, USERS), q, modes=Modes(strict_refs=True)).count() == 0
    back = Query(["x"]).must(V("y"), "name", V("n")).must(V("x"), "boss", V("y"))
    assert run(source(spark, USERS), back, modes=Modes(strict_refs=True)).count() == 3


def test_numbers_near_each_other(spark):
    tiny = 0.1 + 2.0**-54
    data = [("a", "p", ("num", 0.1)), ("b", "q", ("num", tiny)), ("c", "q", ("num", float("nan"))), ("d", "p", ("num", float("nan"))), ("e", "p", ("num", math.inf)), ("f", "q", ("num", math.inf)), ("g", "p", ("num", -0.0)), ("h", "q", ("num", 0.0)), ("i", "p", ("num", 3.0)), ("j", "q", ("num", 3.0))]
    q = Query(["x", "y"]).must(V("x"), "p", V("v")).must(V("y"), "q", V("v"))
    assert {tuple(r) for r in run(source(spark, data), q).collect()} >= {("#g", "#h"), ("#i", "#j")}
    got = {tuple(r) for r in run(source(spark, data), q, modes=Modes(epsilon_joins=True)).collect()}
    assert got == {("#a", "#b"), ("#g", "#h"), ("#i", "#j")}
    assert run(source(spark, data), Query(["x"]).must(V("x"), "q", math.nan)).count() == 0
    assert run(source(spark, data), Query(["x"]).must(V("x"), "q", math.inf)).count() == 0
    assert [r.x for r in run(source(spark, data), Query(["x"]).must(V("x"), "q", 0.1)).collect()] == ["#b"]


def test_many_values_of_one_attribute(spark):
    data = [("m", "cast", ("ref", "p1")), ("m", "cast", ("ref", "p2")), ("p1", "name", ("str", "A")), ("p2", "name", ("str", "B"))]
    q = Query(["n"]).must(V("m"), "cast", V("p")).must(V("p"), "name", V("n"))
    assert sorted(r.n for r in run(source(spark, data, False), q, {"n": "str"}).collect()) == ["A", "B"]
    check(spark, data, q, single=False)


def test_empty_and_malformed(spark):
    empty = source(spark, [])
    assert run(empty, Query(["x", "no"]).must(V("x"), "a", V("v"))).columns == ["x", "no"]
    with pytest.raises(InvalidQuery):
        Pattern(Var(""), "a", 1)
    with pytest.raises(InvalidQuery):
        Pattern(V("x"), "a", [1])


def test_filters_see_unbound_as_missing(spark):
    q = Query(["x"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("g")).having("g", lambda v: ~v.bound)
    assert [r.x for r in run(source(spark, USERS), q, {"x": "id"}).collect()] == ["u3"]
    assert run(source(spark, USERS), Query(["x"]).must(V("x"), "name", V("n")).having("zz", lambda v: v.num > 1)).count() == 0


def test_star_is_one_scan_without_join(spark):
    q = Query(["x", "n", "g"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("g"))
    plan = run(source(spark, USERS), q)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["combined", "optional_chain", "optional_rebind", "optional_one", "where_not_attr"])
def test_no_nested_loops_for_variables_that_may_be_unbound(spark, name):
    from quillon import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unbound_variables_in_longer_chains(spark):
    """Two variables that may both be unbound are shared with one pattern; a third pattern binds what they left."""
    for q in (
        Query(["x", "g", "y"]).must(V("x"), "name", V("n")).may(V("x"), "age", V("g")).may(V("x"), "boss", V("y")).may(V("y"), "age", V("g")),
        Query(["x", "y", "a"]).must(V("x"), "name", V("n")).may(V("x"), "boss", V("y")).may(V("y"), "active", V("a")).must_not(V("y"), "boss", V("x")),
    ):
        check(spark, USERS, q)
        check(spark, USERS, q, Modes(fuse_stars=False))
