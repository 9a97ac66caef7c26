"""Every query with SQL against DuckDB on the same tables."""

import glob
import math

import pytest

import __spark_entry__ as entry
from skytriage import queries as core

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_oracle(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*names).collect()), key=str)
    cur = duck.execute(core.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
    assert got, "an empty result tells nothing"


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
