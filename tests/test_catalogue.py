"""Every registered query against its DuckDB SQL on the smallest tables, and the entry module."""

import duckdb
import pytest

import __spark_entry__
from boxwright.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "supplier", "customer", "events", "nation", "region"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    rows = got.collect()
    if name in catalogue.ORACLE_SQL:
        want = db.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(want.fetchall())
    else:
        assert rows
    spark.catalog.clearCache()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
