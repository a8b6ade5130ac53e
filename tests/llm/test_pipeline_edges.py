"""Each stage of the pipeline, and all of them, over nulls, empty and very long texts, repeated rows and empty tables."""

import pytest

import corpus_pipeline as cp
from util import DOC, edited, prose, rng

R = rng(71)
BENCH = "item_id long, text string"


def lines(n, words=9):
    return "\n".join(prose(R, words, 10**6) + "." for _ in range(n))


def frame(spark, rows):
    """(id, text) with nulls in the other columns of every second row."""
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None if k % 3 else "s", None if k % 2 else 7) for k, (i, t) in enumerate(rows)], DOC)


def seen(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    item = prose(rng(72), 60, 10**6)
    spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, "--")], BENCH).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{path}/none/benchmark.parquet")
    return str(path), item


def test_quality_rules(spark, bench):
    good, long, short = lines(8), lines(6000), lines(2, 5)
    rows = [(1, good), (1, good), (None, good), (3, None), (4, ""), (5, short), (6, long), (7, f"{good}\nHome | About | Login | Help.\n"), (8, " \n" * 500)]
    got = cp.quality_rules(spark, frame(spark, rows), bench[0])
    assert got.columns == list(cp.COLUMNS)
    assert seen(got) == sorted([(1, good), (1, good), (None, good), (6, long), (7, good + "\n")], key=str)
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_line_dedup(spark, bench):
    three, other = lines(3), lines(40_000)
    rows = [(2, three), (2, three), (None, three), (5, f"new\n{three}\nend"), (6, None), (7, ""), (8, "one\ntwo"), (9, "one\ntwo"), (10, other)]
    got = cp.line_dedup_stage(spark, frame(spark, rows), bench[0])
    assert got.columns == list(cp.COLUMNS)
    assert seen(got) == sorted([(None, three), (5, "new\nend"), (6, None), (7, ""), (8, "one\ntwo"), (9, "one\ntwo"), (10, other)], key=str)


def test_near_dedup(spark, bench):
    a, long = prose(R, 300, 10**6), prose(R, 60_000, 10**6)
    near = edited(R, a, 2)
    rows = [(4, a), (4, a), (7, near), (None, a), (8, None), (9, ""), (10, None), (11, long), (12, edited(R, long, 50)), (13, "a b")]
    got = cp.near_dedup(spark, frame(spark, rows), bench[0])
    assert got.columns == list(cp.COLUMNS)
    assert seen(got) == sorted([(4, a), (None, a), (8, None), (9, ""), (10, None), (11, long), (13, "a b")], key=str)


def test_decontamination(spark, bench):
    path, item = bench
    rows = [(1, f"x {item.upper()} y"), (1, f"x {item.upper()} y"), (None, item), (2, None), (3, ""), (4, prose(R, 50_000, 10**6) + " " + item), (5, prose(R, 50_000, 10**6)), (6, item[: len(item) // 2])]
    got = cp.decontamination(spark, frame(spark, rows), path)
    assert got.columns == list(cp.COLUMNS)
    assert sorted(str(i) for i, _ in seen(got)) == ["2", "3", "5", "6"]
    assert cp.decontamination(spark, frame(spark, rows), f"{path}/none").count() == len(rows)


def test_tokenise(spark, bench):
    rows = [(1, "a b"), (1, "a b"), (None, "é漢𝒳"), (2, None), (3, ""), (4, "word " * 40_000)]
    got = cp.tokenise(spark, frame(spark, rows), bench[0]).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id in (2, 3)} == {2: 0, 3: 0} and all(len(r.tokens) == 4 * r.n_tokens for r in got)


def test_empty_tables_and_all_stages(spark, bench, tmp_path):
    path, item = bench
    empty = frame(spark, [(1, "x")]).limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, empty, path)
        assert out.collect() == [] and (name == "byte_bpe" or out.columns == list(cp.COLUMNS))
    good = lines(8)
    rows = [(1, good), (1, good), (2, good), (None, None), (3, lines(9) + "\n" + item + "."), (None, lines(7))]
    for given, want in (([], []), (rows, [None, 1])):
        sf = f"{tmp_path}/{len(given)}"
        frame(spark, given or [(1, "x")]).where("true" if given else "false").write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
        assert sorted((r.doc_id for r in cp.run(spark, sf).collect()), key=str) == sorted(want, key=str)
