"""Queries p5_: splits of spelling pairs that keep files and papyri together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import splits
from lexiloom.session import Scratch

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "ties")
    comps = splits.components(splits.edges(_table(spark, d, "choice_records")), scratch)
    return scratch.write(splits.split_rows(_table(spark, d, "results_lm_paired"), comps, "result_id", "source_file", "split"), "mixed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_pairs(_mixed(spark, d)).select(F.col("a").alias("result_id_a"), F.col("b").alias("result_id_b"))


def p5_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The same ties in linear form: rows by split of each set of tied results, named by its smallest result_id."""
    return splits.conflicts(_mixed(spark, d)).withColumnRenamed("first_id", "first_result_id")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, component, label, split); the label is the edition series that opens the path."""
    scratch = Scratch(spark, "splits")
    records = _table(spark, d, "choice_records").select("record_id", "source_file", "tm_id")
    comps = splits.components(splits.edges(records), scratch)
    label = F.regexp_extract(F.lower("source_file"), r"([a-z]+)[^a-z]+([a-z]+)", 0)
    rows = splits.component_of(records.select("record_id", "source_file", "tm_id", label.alias("label")), comps, "source_file", "tm_id")
    rows = scratch.write(rows.select("record_id", F.coalesce("component", F.concat(F.lit("r"), F.col("record_id"))).alias("component"), "label"), "rows")
    sized = scratch.write(rows.groupBy("component", "label").agg(F.count("*").alias("n")), "sized")
    return rows.join(splits.assign_splits(sized, TARGETS), "component")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("record_id", "component", "split")


def p5_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Records and shares by split and label, beside the target."""
    counts = _assigned(spark, d).groupBy("split", "label").agg(F.count("*").alias("n"))
    whole = counts.groupBy("label").agg(F.sum("n").alias("label_n"))
    target = F.create_map(*[x for k, v in TARGETS.items() for x in (F.lit(k), F.lit(v))])
    return counts.join(whole, "label").select("split", "label", "n", (F.col("n") / F.col("label_n")).alias("share"), target[F.col("split")].alias("target"))


def p5_split_broken(spark: SparkSession, d: str) -> DataFrame:
    """Files and papyri whose records stand in more than one split; there must be none."""
    rows = _assigned(spark, d).join(_table(spark, d, "choice_records").select("record_id", "source_file", "tm_id"), "record_id")
    ties = F.concat(F.array(F.concat(F.lit("f"), splits.file_key("source_file"))), F.transform(splits.papyri(F.col("tm_id")), lambda p: F.concat(F.lit("p"), p)))
    # the key is computed below the aggregate
    tied = rows.select("split", ties.alias("ties")).select("split", F.explode("ties").alias("tie")).where("tie is not null")
    return tied.groupBy("tie").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def p5_split_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Labels of at least a thousandth of all records, and all records, that miss a target by more than 3 points.

    Where one component holds more than that of a label, by more than that component, as it cannot be cut.
    """
    rows = _assigned(spark, d)
    sized = rows.groupBy("component", "label", "split").agg(F.count("*").alias("n"))
    labelled = sized.groupBy("label").agg(F.max("n").alias("largest"), *[F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)).alias(k) for k in TARGETS])
    whole = sized.groupBy("component", "split").agg(F.sum("n").alias("n"))
    whole = whole.agg(F.max("n").alias("largest"), *[F.sum(F.when(F.col("split") == k, F.col("n")).otherwise(0)).alias(k) for k in TARGETS])
    n = sum((F.col(k) for k in TARGETS), F.lit(0))
    # as many rows as labels; that of all records is the largest
    out = labelled.unionByName(whole.withColumn("label", F.lit("all"))).withColumn("n", n).withColumn("total", F.max("n").over(Window.partitionBy())).where("n >= total / 1000")
    off = F.greatest(*[F.abs(F.col(k) - F.col("n") * share) for k, share in TARGETS.items()])
    return out.withColumn("deviation", F.round(F.try_divide(off, F.col("n")), 6)).where(off > F.greatest(F.col("n") * 0.03, F.col("largest"))).select("label", "deviation")


QUERIES = {"p5_conflicts": p5_conflicts, "p5_split_broken": p5_split_broken, "p5_split_deviation": p5_split_deviation, "p5_found": p5_found, "p5_split": p5_split, "p5_split_report": p5_split_report}

_KEY = "regexp_replace(replace(lower(nfc_normalize(source_file)), 'ς', 'σ'), '[^\\p{L}\\p{M}\\p{N}]', '', 'g')"
_REACH = f"""with recursive
e as (select distinct {_KEY} as f, ltrim(unnest(regexp_extract_all(tm_id, '\\d+')), '0') as p from choice_records),
e2 as (select * from e where p <> ''),
n as (select distinct a.f as f, b.f as g from e2 a join e2 b on a.p = b.p),
r as (select result_id, {_KEY} as f, lower(trim(split)) as split from results_lm_paired where split is not null),
reach(f, g) as (select distinct f, f from r union select x.f, n.g from reach x join n on x.g = n.f)
"""
ORACLE_SQL = {
    "p5_found": _REACH + """select distinct a.result_id as result_id_a, b.result_id as result_id_b from r a join reach x on a.f = x.f join r b on b.f = x.g
where a.result_id < b.result_id and a.split <> b.split""",
    "p5_conflicts": _REACH + """, c as (select a.result_id, a.split, min(b.result_id) as first_result_id, count(distinct b.split) as k from r a join reach x on a.f = x.f join r b on b.f = x.g group by 1, 2)
select first_result_id, split, count(*) as n from c where k > 1 group by 1, 2""",
    # what must not be
    "p5_split_broken": "select source_file as tie, 2::bigint as n_splits from choice_records where false",
    "p5_split_deviation": "select source_file as label, 0::double as deviation from choice_records where false",
}
