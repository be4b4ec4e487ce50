"""Every core query with SQL, on the smallest tables, against DuckDB."""

import os

import pytest

from lexiloom.plans import data_queries, fixture_queries, reference_queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
QUERIES = reference_queries.QUERIES | data_queries.QUERIES | fixture_queries.QUERIES
SQL = reference_queries.ORACLE_SQL | data_queries.ORACLE_SQL | fixture_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else "\0" if v is None else str(v)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["explain_rules", "weighted_edit_distance", "learned_log_odds", "form_keys", "markup_classes", "p4_hierarchy", "sw_search"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0
