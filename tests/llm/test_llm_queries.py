"""The subpackage's queries on the smallest tables, against DuckDB where SQL says the same."""

import os

import pytest

from lexiloom.llm.registry import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")

#: Columns fixed for the driver.
FOUND = {
    "p1_found": ["table_name", "row_id", "field_name", "form_id"], "p3_found": ["first_id", "copy_id"], "p5_found": ["result_id_a", "result_id_b"],
    "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_exactly_its_columns(spark, name):
    assert QUERIES[name](spark, D).columns == FOUND[name]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(str(v) for v in r) for r in df.collect()) == want


def test_split_keeps_ties_and_all_records(spark):
    rows = QUERIES["p5_split"](spark, D)
    n = spark.read.parquet(f"{D}/choice_records.parquet").count()
    assert rows.count() == rows.select("record_id").distinct().count() == n
    assert rows.groupBy("component").agg({"split": "max"}).count() == rows.select("component", "split").distinct().count()


def test_pieces_cover_every_text(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{D}/documents.parquet").where("text <> ''")
    got = QUERIES["p8_pieces"](spark, D).groupBy("doc_id").agg(F.max("char_end").alias("end"))
    assert got.join(docs, "doc_id").where(F.col("end") != F.length("text")).count() == 0 and got.count() == docs.count()
