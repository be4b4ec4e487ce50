"""The reference catalogue: filters, pages, inherited rules, foreign keys, and left enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, equals: dict | None = None, contains: dict | None = None) -> DataFrame:
    """Rows that meet every given condition; a condition on None is left out."""
    out = rows
    for c, v in (equals or {}).items():
        if v is not None:
            out = out.where(F.col(c) == F.lit(v))
    for c, v in (contains or {}).items():
        if v is not None:
            out = out.where(F.array_contains(c, v))
    return out


def page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page with the ``total`` beside it; limits are 1 to 200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit is 1 to 200, offset 0 or more")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def posting_lists(rows: DataFrame, key: Column, item: str, order: list[str]) -> DataFrame:
    """(key, items, n): the items of each key in order; rows without a key are left out."""
    lists = rows.withColumn("_key", key).where("_key is not null").groupBy(F.col("_key").alias("key"))
    return lists.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))), lambda x: x["_item"]).alias("items"), F.count("*").alias("n"))


def found(rows: DataFrame, order: list[Column], equals: dict | None = None, contains: dict | None = None) -> DataFrame:
    """What ``matching`` keeps, with its ``place`` in the catalogue's order; for lists short enough to be shown."""
    return matching(rows, equals, contains).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def find_rules(rules: DataFrame, section: str | None = None, category: str | None = None, dialect: str | None = None) -> DataFrame:
    return found(rules, [F.col("id")], {"buck_section": section, "category": category}, {"affected_dialects": dialect})


def find_glossary(entries: DataFrame, dialect: str | None = None, rule_id: str | None = None) -> DataFrame:
    return found(entries, [F.col("word"), F.col("dialect"), F.coalesce("rule_id", F.lit(""))], {"dialect": dialect, "rule_id": rule_id})


def inherited(ancestors: DataFrame, own: DataFrame, node: str, rule: str) -> DataFrame:
    """(node, rule, depth): own rules (depth 0) and those of every ancestor, each at its smallest depth.

    ``ancestors`` is (ancestor_id, descendant_id, steps), as hierarchies give it; ``own`` (node, rule).
    """
    above = ancestors.join(own.withColumnRenamed(node, "ancestor_id"), "ancestor_id").select(F.col("descendant_id").alias(node), rule, F.col("steps").alias("depth"))
    every = own.select(node, rule, F.lit(0).alias("depth")).unionByName(above)
    return every.groupBy(node, rule).agg(F.min("depth").alias("depth"))


def missing_keys(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null ``column`` names no ``key``."""
    known = keys.select(F.col(key).alias("_key")).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti")


def enrich(rows: DataFrame, refs: DataFrame, key: str, fields: list[str], order: list[str], out: str = "refs") -> DataFrame:
    """``rows`` with an array of their references, empty where there is none."""
    lists = refs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(out))
    joined = rows.join(lists, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(joined.schema[out].dataType)))


def annotations(steps: DataFrame, rule_sections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(hit, step, rule_id, catalogue_id): catalogue rules of the sections each step's rule cites, each once per hit and rule."""
    joined = steps.join(rule_sections, "rule_id").join(catalogue, "section")
    rn = F.row_number().over(Window.partitionBy("hit", "rule_id", "catalogue_id").orderBy("step"))
    return joined.withColumn("_rn", rn).where("_rn = 1").select("hit", "step", "rule_id", "catalogue_id")


def merge_lexicons(first: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Union by id: an identical row is taken once, a different one under a known id raises."""
    cols = first.columns
    both = first.select(F.struct(*cols).alias("row"), F.col(key)).unionByName(more.select(*cols).select(F.struct(*cols).alias("row"), F.col(key)))
    grouped = both.groupBy(key).agg(F.min("row").alias("row"), F.max("row").alias("other"))
    checked = F.when(~F.col("row").eqNullSafe(F.col("other")), F.raise_error(F.concat(F.lit("conflicting rows for "), F.col(key).cast("string")))).otherwise(F.lit(None))
    return grouped.where(checked.isNull()).select("row.*")


def first_seen(a: Column) -> Column:
    return F.array_distinct(a)


def drop_reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in the given order; empty means keep."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
