"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, str(SF))
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    b = sorted(([plain(x) for x in r] for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=str)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: types.get(k, k) for c, k in got.dtypes} == {c: kinds[c] if kinds[c] in types.values() else dict(got.dtypes)[c] for c in columns}


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert catalogue.queries()[name](spark, str(SF)).limit(1).count() == 1, name
