"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tremor.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert shown(got.select(*cols).collect()) == shown(want.select(", ".join(cols)).fetchall())


def test_entry_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
