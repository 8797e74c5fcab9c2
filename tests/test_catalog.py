"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from quillspan.plans import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    return sorted(repr(tuple(x if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(list(x)) if isinstance(x, list) else str(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'" if os.path.isfile(f"{DIR}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet/*.parquet'")
    want = con.execute("SELECT " + ", ".join(columns) + f" FROM ({sql})").fetchall()
    assert plain(rows) == plain(want)
