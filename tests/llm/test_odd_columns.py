"""Every operator over a table whose other columns have names of its own working columns, dots, quotes and nested types."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, langid, licenses, line_dedup, minhash, passages, quality, sharding, url_filter
from util import prose, rng

NAMES = ["__t", "__w", "__l", "__h", "__in", "__pos", "__k1", "__lines", "__gone", "__row", "__part", "__rank", "__url", "__some", "token", "slot", "rank", "h", "c0", "a.b", "q`q", "with space"]


@pytest.fixture(scope="module")
def table(spark):
    r = rng(61)
    shared = "\n".join(prose(r, 9) + "." for _ in range(12))
    texts = [shared, f"start.\n{shared}", prose(r, 80), "All rights reserved.", "", None, prose(r, 30_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("url", F.lit("http://a.com/en/x"))
    for i, n in enumerate(NAMES):
        df = df.withColumn(n, F.struct(F.lit(i).alias("x y"), F.array(F.lit("v")).alias("`")) if i % 2 else F.lit(i))
    return df


OPERATORS = {
    "url_filters": lambda df, spark: url_filter.filter_urls(df),
    "licenses": lambda df, spark: licenses.scan_licenses(df),
    "quality": lambda df, spark: quality.apply_quality(df),
    "sharding": lambda df, spark: sharding.assign_shards(df, "id"),
    "bpe": lambda df, spark: bpe.decode(bpe.encode(df, bpe.share_vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)), bpe.share_vocabulary(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)),
    "lines": lambda df, spark: line_dedup.dedup_lines(df, "id"),
    "passages": lambda df, spark: passages.dedup_passages(df, "id"),
    "near": lambda df, spark: minhash.drop_near_duplicates(df, "id"),
    "language": lambda df, spark: langid.predict(df, langid.train([("the cat", "en"), ("le chat", "fr")])),
    "benchmark": lambda df, spark: decontam.find_benchmark(df, spark.createDataFrame([(1, "all rights reserved")], "item_id int, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_come_back(spark, table, name):
    made = {"slot"} if name == "sharding" else set()
    rows = OPERATORS[name](table, spark).collect()
    want = {r.id: r for r in table.collect()}
    assert len(rows) == len(want) - (name == "near") and {r.id for r in rows} <= set(want)
    for r in rows:
        assert all(r[c] == want[r.id][c] for c in NAMES if c not in made)


def test_workers_need_not_have_the_package(spark, table, tmp_path):
    """What travels to workers is loaded by an interpreter that can't import the package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from quillon.llm.common import map_batches

    index = decontam.Index([(1, "one two three four five six")], 5, 80)
    model = langid.train([("the cat", "en"), ("le chat", "fr")])
    scan = licenses.Templates(licenses.TEMPLATES)
    made = [index.search, model.emissions, scan.scan, bpe.stitch, minhash._whole_groups, langid.posteriors, map_batches]
    (tmp_path / "made").write_bytes(cloudpickle.dumps(made))
    code = f"import pickle, sys; made = pickle.load(open({str(tmp_path / 'made')!r}, 'rb')); assert 'quillon' not in sys.modules; print(made[0]([]), len(made))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "[] 7", out.stderr[-2000:]
