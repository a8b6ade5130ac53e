import pytest
from pyspark.sql import functions as F

from quillon.functions.predicates import InvalidQuery
from quillon.operators import documents as d
from quillon.sources.triples import SCHEMA, TripleSource

SCHEMA_D = d.Schema({"users": {"name": d.string(fallback="Anon"), "age": d.number(optional=True), "active": d.boolean(optional=True, fallback=True), "boss": d.ref("users")}, "cars": {"maker": d.string(fallback="?")}})


@pytest.fixture(scope="module")
def users(spark):
    rows = spark.createDataFrame([("u1", "Ann", 30.0, False, None), ("u2", "Bob", None, None, "u1"), ("u3", "Cem", 25.0, True, "u1")], "id string, name string, age double, active boolean, boss string")
    triples = d.Documents(TripleSource(spark.createDataFrame([], SCHEMA)), SCHEMA_D, "users").create(rows)
    other = spark.createDataFrame([("c1", "cars/id", "str", "c1", None, None, None), ("c1", "users/name", "str", "Odd", None, None, None), ("u4", "users/id", "str", "u4", None, None, None)], SCHEMA)
    return d.Documents(TripleSource(triples.unionByName(other)), SCHEMA_D, "users")


def got(df):
    return [tuple(r) for r in df.collect()]


def test_only_the_type_with_fallbacks(users):
    assert sorted(got(users.query(["id", "name", "active"]))) == [("u1", "Ann", False), ("u2", "Bob", True), ("u3", "Cem", True), ("u4", "Anon", True)]


def test_missing_last_in_both_directions(users):
    assert [r[0] for r in got(users.query(["id", "age"], order_by=[("age", "asc"), ("id", "asc")]))] == ["u3", "u1", "u2", "u4"]
    assert [r[0] for r in got(users.query(["id", "age"], order_by=[("age", "desc"), ("id", "asc")], limit=3))] == ["u1", "u3", "u2"]
    assert got(users.query(["id"], limit=0)) == []
    with pytest.raises(InvalidQuery):
        users.query(["id"], limit=-1)


def test_filters(users):
    ids = lambda where: sorted(r[0] for r in got(users.query(["id"], where)))
    assert ids({"active": {"isDefined": False}}) == ["u2", "u4"]
    assert ids({"active": True}) == ["u2", "u3", "u4"]
    assert ids({"age": {"notEquals": 30}}) == ["u2", "u3", "u4"]
    assert ids({"age": {"greaterThan": 20, "lessThanOrEqual": 25}}) == ["u3"]
    assert ids({"name": {"startsWith": "A"}}) == ["u1", "u4"]
    assert ids({"boss": "u1"}) == ["u2", "u3"]
    assert ids({"name": {"in": ["Bob", "Cem"]}, "id": {"notIn": ["u3"]}}) == ["u2"]
    assert ids({"age": {"isUndefined": True}}) == ["u2", "u4"]


@pytest.mark.parametrize("where", [{"nope": 1}, {"age": {"equals": "x"}}, {"age": {"contains": "x"}}, {"active": {"greaterThan": 1}}, {"age": {"equals": True}}])
def test_illegal_filters(users, where):
    with pytest.raises(InvalidQuery):
        users.query(["id"], where)


def test_schema_rules():
    for bad in (lambda: d.string(), lambda: d.number(fallback="x"), lambda: d.Field("ref", True, "x"), lambda: d.Schema({"e": {"id": d.string(fallback="")}}), lambda: d.number(fallback=True)):
        with pytest.raises(ValueError):
            bad()


def test_create_checks(spark, users):
    with pytest.raises(InvalidQuery):
        users.create(spark.createDataFrame([("x", 1)], "id string, nope int"))
    with pytest.raises(InvalidQuery):
        users.create(spark.createDataFrame([("x", 1.0)], "id string, age double"))
    with pytest.raises(Exception, match="needs the field name"):
        users.create(spark.createDataFrame([("x", None)], "id string, name string")).collect()


def test_aggregates(users):
    assert got(users.aggregate({"n": ("count", "*"), "ages": ("count", "age"), "top": ("max", "age")})) == [(4, 2, 30.0)]
    assert sorted(got(users.aggregate({"n": ("count", "*")}, ["active"]))) == [(False, 1), (True, 3)]
    with pytest.raises(InvalidQuery):
        users.aggregate({})
    with pytest.raises(InvalidQuery):
        users.aggregate({"x": ("sum", "name")})


def test_pages_cover_everything_once(users):
    seen, after = [], None
    while page := got(users.page(["age"], "age", 2, after)):
        seen += [r[0] for r in page]
        after = (page[-1][1], page[-1][0])
    assert seen == ["u3", "u1", "u2", "u4"]


@pytest.mark.parametrize("order", [[("age", "asc")], [("age", "desc")], [("active", "desc"), ("age", "asc")], [("name", "asc"), ("age", "desc")]])
def test_pages_in_both_directions(users, order):
    """Forth from the start and back from the end, page by page: the whole order each time."""
    keys = [f for f, _ in order]
    raw = {r[0]: r[1:] for r in got(users._raw(keys).select("id", *keys))}
    want = [r[0] for r in got(users.query(["id"], order_by=[*order, ("id", "asc")]))]
    for size in (1, 2, 3):
        seen, at = [], None
        while page := got(users.page(keys, order, size, after=at)):
            seen += [r[0] for r in page]
            at = (*raw[seen[-1]], seen[-1])
        assert seen == want
        back, at = [], (*raw[want[-1]], want[-1])
        while page := got(users.page(keys, order, size, before=at)):
            back = [r[0] for r in page] + back
            at = (*raw[back[0]], back[0])
        assert back == want[:-1]
    assert got(users.page_totals(3)) == [(4, 2)]
    for bad in ({"after": (1,)}, {"after": (1, "a"), "before": (1, "a")}):
        with pytest.raises(InvalidQuery):
            users.page(keys[:1], keys[0], 2, **bad)


def test_relations(users):
    rows = {r.id: [x.id for x in r.staff] if r.staff else None for r in users.related(["id"], users, "boss", ["id", "name"], "staff", ("name", "desc"), 1).collect()}
    assert rows == {"u1": ["u3"], "u2": None, "u3": None, "u4": None}


def test_update_and_delete_many(users):
    assert got(users.update_many({"age": {"greaterThan": 0}}, {"age": F.col("age") + 1}).select("e", "n").orderBy("e")) == [("u1", 31.0), ("u3", 26.0)]
    assert {r.a for r in users.delete_many({"id": "u1"}).collect()} == {"users/id", "users/name", "users/age", "users/active"}
