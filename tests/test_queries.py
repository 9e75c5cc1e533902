"""Every registered SQL against its query, on the smallest tables."""

import math
import os

import duckdb
import pytest

from terrane.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def rows(found, columns):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    there = con.sql(ORACLE[name])
    assert sorted(there.columns) == columns
    place = {c: i for i, c in enumerate(there.columns)}
    got = rows(df.collect(), columns)
    assert got == rows([{c: r[place[c]] for c in columns} for r in there.fetchall()], columns)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
