"""Queries p6_: evaluation passages that leaked into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.unicode import nfc
from lexiloom.llm import leakage


def _leaks(spark: SparkSession, d: str, spans: bool = True) -> DataFrame:
    return leakage.leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"), spans=spans)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, spans=False).distinct()


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The merged spans to remove from each document, with the items found in them."""
    rows = _leaks(spark, d).select("doc_id", "item_id", F.inline("spans"))
    return rows.select("doc_id", "item_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def p6_span_words(spark: SparkSession, d: str) -> DataFrame:
    """Per document and item, the spans and the words cut out with them, counted anew in the text between the bounds."""
    text = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    cut = p6_spans(spark, d).join(text, "doc_id").withColumn("cut", F.expr("substring(text, span_start + 1, span_end - span_start)"))
    cut = cut.select("doc_id", "item_id", F.size(F.regexp_extract_all(F.lower(nfc("cut")), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("n"))
    return cut.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_spans"), F.sum("n").alias("n_words"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each item that leaked, the number of documents that hold some of it."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


QUERIES = {"p6_found": p6_found, "p6_spans": p6_spans, "p6_span_words": p6_span_words, "p6_items": p6_items}

_WORDS = "list_filter(regexp_split_to_array(replace(lower(nfc_normalize(text)), 'ς', 'σ'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_FOUND = f"""with recursive
dw as (select doc_id, {_WORDS} as w from documents where text is not null),
iw as (select item_id, {_WORDS} as w from eval_items),
ig as (select distinct item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12)),
dg as (select doc_id, i, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12))
"""
ORACLE_SQL = {
    "p6_found": _FOUND + "select distinct doc_id, item_id from dg join ig using (g)",
    "p6_span_words": _FOUND + """, m as (select distinct doc_id, item_id, i from dg join ig using (g)),
s as (select *, coalesce(i - lag(i) over w > 12, true)::int as fresh from m window w as (partition by doc_id, item_id order by i)),
k as (select *, sum(fresh) over (partition by doc_id, item_id order by i) as span from s),
r as (select doc_id, item_id, span, max(i) - min(i) + 12 as n from k group by 1, 2, 3)
select doc_id, item_id, count(*) as n_spans, sum(n)::bigint as n_words from r group by 1, 2""",
    "p6_items": _FOUND + "select item_id, count(distinct doc_id) as n_documents from dg join ig using (g) group by 1",
}
