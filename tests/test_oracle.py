"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from shapelab.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    rows = registry.queries()[name](spark, DIR)
    got = rows.collect()
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(rows.columns) == sorted(cols)
    assert sorted(tuple(str(plain(r[c])) for c in cols) for r in got) == sorted(tuple(str(plain(v)) for v in r) for r in want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["answer", "n", "accuracy"] and df.count() == 2


def test_every_query_has_a_callable():
    import __spark_entry__

    assert all(map(callable, __spark_entry__.queries().values()))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
