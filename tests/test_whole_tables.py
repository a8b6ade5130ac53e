"""Queries over whole tables return all of their rows."""

import duckdb
import pytest

from quillon import queries

SF = "/root/testdata/sf0.01"
COUNTS = {
    "optional_chain": ("count(*)", "SELECT count(*) FROM orders"),
    "display_datoms": ("count(*)", "SELECT count(*) FROM customer"),
    "index_membership": ("count(*)", "SELECT count(DISTINCT l_partkey) FROM lineitem JOIN part ON p_partkey = l_partkey"),
    "bgp_value_join": ("sum(pairs)", "SELECT sum(k) FROM (SELECT count(*) AS k FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY s_suppkey)"),
}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_nothing_is_cut(spark, name):
    mine, theirs = COUNTS[name]
    c = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).selectExpr(f"{mine} AS k").first().k
    assert 0 < got == c.execute(theirs).fetchone()[0]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_missing_values_come_last(spark, tmp_path, direction):
    """2,000 customers, every fourth without a balance."""
    rows = [(k, f"c{k}", -5.0 if k % 4 == 0 else float(k * 7 % 1999), "BUILDING", 1) for k in range(2000)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = [r.id for r in queries.QUERIES[f"order_nulls_last_{direction}"](spark, str(tmp_path)).collect()]
    sign = 1 if direction == "asc" else -1
    want = sorted(rows, key=lambda r: (r[2] < 0, sign * r[2] if r[2] >= 0 else 0, f"customer:{r[0]}"))
    assert got == [f"customer:{r[0]}" for r in want]
