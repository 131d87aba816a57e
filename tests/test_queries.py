"""Every query against its SQL twin, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from finlattice import catalogue_jobs as catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.13g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_twin(spark, name):
    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents labels conversations pages".split():
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want
