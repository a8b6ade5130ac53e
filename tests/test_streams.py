from quillon.operators.scans import attribute
from quillon.sources.triples import SCHEMA, read_triples, write_triples
from quillon.streaming import feed, windows


def test_reactive_queries_run_when_their_attributes_change(spark, tmp_path):
    schema = "e string, a string"
    spark.createDataFrame([("x", "p")], schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    spark.createDataFrame([("x", "q")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    log = feed.read_log(spark, f"{tmp_path}/log", schema, 1)
    seen = []
    answer = lambda: spark.range(3)
    feed.reactive(log, answer, lambda df: seen.append(df.count()), f"{tmp_path}/c1", ["q"]).awaitTermination()
    assert seen == [3]
    feed.reactive(log, answer, lambda df: seen.append(df.count()), f"{tmp_path}/c2").awaitTermination()
    assert seen == [3, 3, 3]


def test_streamed_windows_with_a_watermark(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS t, 'k' AS k UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'k'").coalesce(1).write.parquet(f"{tmp_path}/ev")
    spark.sql("SELECT timestamp'2024-01-01 00:20:00' AS t, 'k' AS k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema("t timestamp, k string").parquet(f"{tmp_path}/ev")
    feed.drain(windows.windowed_counts(ev, "t", ["k"], "1 hour", lateness="10 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [r.n for r in got] == [2]


def test_stored_triples_prune_folders(spark, tmp_path):
    rows = [("e1", "t/a", "num", None, 1.0, None, None), ("e1", "t/b", "str", "x", None, None, None), ("e2", "t/a", "num", None, 2.0, None, None)]
    write_triples(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/t")
    src = read_triples(spark, f"{tmp_path}/t")
    df = src.scan(attribute="t/a")
    assert df.count() == 2 and src.df.count() == 3 and attribute(src.df, "t/b").first().s == "x"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(a" in plan and "t/a" in plan
