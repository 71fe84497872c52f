"""Every catalog query against its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from tessella.plans import catalog, coverage, stored  # noqa: F401  coverage and stored add to the catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(values):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row)) for row in values)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    found = catalog.QUERIES[name](spark, str(SF))
    got = [tuple(r) for r in found.collect()]
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(found.columns)
        assert rows(want.select(*found.columns).fetchall()) == rows(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
