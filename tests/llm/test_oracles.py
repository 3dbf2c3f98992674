"""The training-data queries that have SQL give what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from lodestone.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    got, want = queries.queries()[name](spark, str(SF)), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    a = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    assert a == sorted(([plain(x) for x in r] for r in want.select(", ".join(columns)).fetchall()), key=str)


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
