"""The registered queries against their SQL, and row counts of the others."""

import duckdb
import pytest

from scriptloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.ORACLE:
        want = con.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        key = lambda names, rows: sorted(repr([r[i] for i in sorted(range(len(names)), key=names.__getitem__)]) for r in rows)
        assert key(df.columns, got) == key(columns, want.fetchall())
    else:
        assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
