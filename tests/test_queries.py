"""Every query of the graph against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from triplespark.jobs.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda x: str(float(x)) if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    f, text = QUERIES[name]
    df = f(spark, FOLDER)
    columns = sorted(df.columns)
    result = sql.execute(text)
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    assert plain(df.select(*columns).collect()) == plain([tuple(r[found.index(c)] for c in columns) for r in result.fetchall()])
