"""Every core query against its SQL at sf0.001."""

import duckdb
import pytest

from quillon import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(data, names):
    def shown(v):
        return None if v is None else round(float(v), 6) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(shown(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c", "name", "nation", "bal"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
