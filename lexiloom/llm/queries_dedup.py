"""Queries p3_: hidden duplicates of spelling pairs from two deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.dedup import Repeats

FIELDS = ["original", "regularized", "source_file"]


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The JSON lines as records.  A whole number in any writing counts; a broken line gives nulls."""
    got = F.from_json("line", "original string, regularized string, source_file string, pair_index string, tm_id string")
    return lines.select("record_id", got.alias("r")).select(
        "record_id", "r.original", "r.regularized", "r.source_file", F.expr("cast(try_cast(trim(r.pair_index) as double) as int)").alias("pair_index"), "r.tm_id"
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    cols = ["record_id", *FIELDS, "pair_index"]
    first = spark.read.parquet(f"{d}/choice_records.parquet").select(*cols)
    return first.unionByName(parsed_lines(spark.read.parquet(f"{d}/choice_lines.parquet")).select(*cols))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return Repeats(records(spark, d), "record_id", FIELDS, ["pair_index"]).pairs()


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    carry = [*FIELDS, "pair_index"]
    return Repeats(records(spark, d), "record_id", FIELDS, ["pair_index"], carry).collapsed().withColumnRenamed("_id", "record_id")


QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}

_FOLD = "regexp_replace(replace(lower(nfc_normalize({0})), 'ς', 'σ'), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')"
_RECORDS = f"""r as (select record_id, original, regularized, source_file, pair_index from choice_records
 union all select record_id, line->>'original', line->>'regularized', line->>'source_file', try_cast(try_cast(line->>'pair_index' as double) as int) from choice_lines),
k as (select *, {", ".join(f"coalesce({_FOLD.format(c)}, chr(1)) as k_{c}" for c in FIELDS)} from r),
g as (select *, min(record_id) over w as first_id, count(*) over w as n from k
      window w as (partition by k_original, k_regularized, k_source_file, coalesce(pair_index, -1)))"""
ORACLE_SQL = {
    "p3_found": f"with {_RECORDS} select first_id, record_id as copy_id from g where record_id > first_id",
    "p3_collapsed": f"with {_RECORDS} select record_id, original, regularized, source_file, pair_index, n as n_copies from g where record_id = first_id",
}
