"""Every operator's query on the smallest tables: whole results, equal to SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from marlspar.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got
    docs = [r[0] for r in duck.execute("SELECT doc_id FROM documents ORDER BY doc_id").fetchall()]
    if name.split("_")[0] in ("op2", "op3", "op4", "op5", "op6", "op10", "op12"):
        assert sorted(r[columns.index("doc_id")] for r in got) == docs
    if name in oracle_sql():
        rel = duck.execute(oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=str)
