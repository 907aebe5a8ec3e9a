"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tideline.plans.oracles import ORACLES
from tideline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert __spark_entry__.queries().keys() >= QUERIES.keys()


def test_entry(spark):
    assert not __spark_entry__.entry(spark).isEmpty()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con.execute(ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == columns
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    ours = key([r[c] for c in columns] for r in df.collect())
    theirs = key([r[names.index(c)] for c in columns] for r in con.fetchall())
    assert ours == theirs
