"""Every query with SQL equals DuckDB on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

from marlspar.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert got
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = sorted(([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()), key=str)
        assert got == want
