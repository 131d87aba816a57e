"""The operators that SQL can say against DuckDB on the same tables."""

import duckdb
import pytest

queries = pytest.importorskip("finlattice.llm.queries")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for n in ("documents", "embeddings"):
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)  # nulls sort as text
    res = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=str)
