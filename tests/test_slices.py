"""Running values over slices of a key's order, against plain loops; and what reaches the file scan."""

import random

from pyspark.sql import functions as F

from quillon.operators import slices
from quillon.sources.triples import open_tables


def test_against_loops(spark, monkeypatch):
    r = random.Random(3)
    for n in (1, 7, 1024):
        monkeypatch.setattr(slices, "SLICES", n)
        rows = [(r.choice(["a", "b", None]), i * r.choice([1, 3]) + 1000 * i, r.randrange(50)) for i in range(120)]
        df = spark.createDataFrame(rows, "k string, i long, v long")
        before = {x.i: x.m for x in slices.max_before(df, ("k",), "i", "v", "m").collect()}
        after = {x.i: x.m for x in slices.next_of(df, ("k",), "i", "v", "m").collect()}
        for k, i, _ in rows:
            mine = sorted((j, w) for c, j, w in rows if c == k)
            assert before[i] == max((w for j, w in mine if j < i), default=None)
            assert after[i] == next((w for j, w in mine if j > i), None)


def test_a_key_with_all_rows_is_spread(spark):
    """However far apart its numbers are."""
    for step in (1, 10_000_019):
        df = spark.range(50_000).select(F.lit("k").alias("k"), (F.col("id") * step).alias("i"), F.col("id").alias("v"))
        cut = slices._across(df, ("k",), "i", F.max("v"), lambda c, w: F.max(c).over(w))
        sizes = [r["count"] for r in cut.groupBy("k", "__slice").count().collect()]
        assert len(sizes) == slices.SLICES and max(sizes) < 60
    assert slices.max_before(df.limit(0), ("k",), "i", "v", "m").collect() == []


def test_point_reads_reach_the_scan(spark):
    wide = open_tables(spark, "/root/testdata/sf0.001")
    for df in (wide.scan("customer:7", "customer/c_name"), wide.scan("orders:32")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(" in plan.split("PushedFilters")[1]
    for odd in ("customer:07", "customer:x", "customer:99999999999999999999", "customer:", "customer:-0"):
        assert wide.scan(odd, "customer/c_name").count() == 0


def test_children_are_cut_before_they_are_shuffled(spark):
    from quillon import queries

    plan = queries.relation_nested_topn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert queries.relation_nested_topn(spark, "/root/testdata/sf0.001").where(F.col("top").isNotNull()).count() > 0
