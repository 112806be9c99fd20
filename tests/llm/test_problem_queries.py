"""The queries of the problems against DuckDB on small tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from ctxspark.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    cur = con.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0
