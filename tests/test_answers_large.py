"""Answers about revenues of any size: what is planted as wrong has to be found as wrong."""

import duckdb
import pytest

from quillspan.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("times", [1, 5000])
def test_wrong_sums_are_corrected_at_any_size(spark, tmp_path, times):
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"COPY (SELECT * FROM '{DIR}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (o_totalprice * {times} AS o_totalprice) FROM '{DIR}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    for t in ("customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    columns = "company, year, kind, ok, statuses, corrected"
    want = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()['verify_answers']}) WHERE kind = 'sum'").fetchall()
    got = catalog.queries()["verify_answers"](spark, str(tmp_path)).filter("kind = 'sum'").selectExpr(*columns.split(", ")).collect()
    assert want and sorted(map(tuple, got)) == sorted(want)
