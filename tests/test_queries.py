"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=str)
    done = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in done.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns)
    assert ours == theirs
