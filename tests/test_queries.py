"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

from scriptloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark pages labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert len(got) > 0
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, want.fetchall())
