"""Joins in which a value has many rows on both sides."""

import pytest
from pyspark.sql import functions as F

from quillon.plans import compile
from quillon.plans.compile import Modes, run
from quillon.plans.query import Query, Var as V
from quillon.sources.triples import TripleSource
from test_patterns import check, source

SHARED = Query(["x", "y"]).must(V("x"), "p", V("v")).must(V("y"), "q", V("v"))
#: Three values that many share, one that is missing on either side, and numbers that equal nothing or are near 0.1.
VALUES = [("num", 1.0), ("num", 0.1), ("str", "s"), ("ref", "a0"), ("num", float("nan"))]
DATA = [(f"{e}{i}", e_of, VALUES[i * i % 5 if i % 3 else i % 2]) for e, e_of, n in (("a", "p", 14), ("b", "q", 17)) for i in range(n)]
DATA += [("a90", "p", ("str", "left")), ("b90", "q", ("str", "right")), ("b91", "q", ("num", 0.1 + 2.0**-54)), *[(f"b{i}", "t", ("num", float(i % 3))) for i in range(9)]]


@pytest.mark.parametrize("epsilon", [False, True])
def test_products_of_one_value_are_made_by_all_tasks(spark, epsilon):
    """Both sides are read by one task, as a short file is."""
    n = 2600
    rows = spark.range(0, 2 * n, 1, 1).select(F.concat(F.lit("e"), "id").alias("e"), F.when(F.col("id") < n, "p").otherwise("q").alias("a"), F.lit("num").alias("kind"), F.lit(None).cast("string").alias("s"), F.lit(1.0).alias("n"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("r"))
    made = run(TripleSource(rows), SHARED, modes=Modes(epsilon_joins=epsilon)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == n * n
    assert max(r["count"] for r in made) < 0.6 * n * n


@pytest.mark.parametrize(
    "query",
    [
        SHARED,
        Query(["x", "y"]).must(V("x"), "p", V("v")).may(V("y"), "q", V("v")),
        Query(["x", "y", "z"]).must(V("x"), "p", V("v")).must(V("y"), "q", V("v")).must(V("z"), "q", V("v")),
        Query(["x", "y", "z"]).must(V("x"), "p", V("v")).must(V("y"), "q", V("v")).must(V("y"), "t", V("w")).must(V("z"), "t", V("w")),
        Query(["x", "y"]).must(V("x"), "p", V("v")).must(V("y"), "q", V("v")).must_not_all((V("z"), "t", V("w")), (V("y"), "t", V("w"))),
        Query(["x", "w", "z"]).must(V("x"), "q", V("v")).may(V("x"), "t", V("w")).may(V("z"), "t", V("w")),
    ],
)
@pytest.mark.parametrize("single", [True, False])
def test_dealt_keys_give_the_same_rows(spark, monkeypatch, query, single):
    """Parts of two rows a side; where a value may stand twice, some do."""
    monkeypatch.setattr(compile, "SIDE", 2)
    exact = [t for t in DATA if t[0] != "b91"]
    check(spark, exact if single else exact + exact[::4], query, single=single)


def test_dealt_keys_of_near_numbers(spark, monkeypatch):
    monkeypatch.setattr(compile, "SIDE", 2)
    for query in (SHARED, Query(["x", "y"]).must(V("x"), "p", V("v")).may(V("y"), "q", V("v"))):
        got = check(spark, DATA, query, Modes(epsilon_joins=True))
        assert sum(k for (_, y), k in got.items() if y == "#b91") == sum(t[1:] == ("p", VALUES[1]) for t in DATA) > 2


def test_dealt_keys_of_references(spark, monkeypatch):
    """In the wire's mode, too, every pair of a value stays."""
    plain = sorted(run(source(spark, DATA), SHARED, modes=Modes(strict_refs=True)).collect())
    monkeypatch.setattr(compile, "SIDE", 2)
    assert len(plain) > 50 and sorted(run(source(spark, DATA), SHARED, modes=Modes(strict_refs=True)).collect()) == plain


def test_keys_of_one_side_are_not_counted(spark):
    """Of joins in which one side has a value once, nothing is counted."""
    from quillon import queries

    for name in ("bgp_ref_forward", "bgp_ref_reverse", "optional_many", "optional_chain", "bgp_attr_var", "where_not_conjunctive"):
        assert "h__" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
