"""Every core query on the smallest tables, held against DuckDB where it has SQL."""

import datetime
import decimal
from pathlib import Path

import pytest

from stratakb.queries import catalogue

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, other, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name not in catalogue.ORACLE:
        assert rows
        return
    result = other.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert rows == want


def test_plans_push_down_and_prune(spark):
    """Filters and the needed columns reach the scan."""
    plan = catalogue.QUERIES["lexical_first_n"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "dense_vector" not in plan and "ReadSchema: struct<" in plan and "IsNotNull(chunk_id)" in plan
    plan = catalogue.QUERIES["delete_by_doc"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "dense_vector" not in plan
