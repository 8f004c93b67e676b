"""Every registered query against its SQL in DuckDB, on the small tables."""

import importlib.util

import duckdb
import pytest

from granary.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else repr(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(key(r) for r in got.select(columns).collect())
    b = sorted(key(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b


def test_entry_stands_without_the_text_package():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec is not None
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
