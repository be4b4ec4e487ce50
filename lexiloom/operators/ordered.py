"""Lookback over ordered rows whose groups may be of any size.

A plain window keeps a whole group in one task.  Here rows are range-partitioned by group
and order, so a large group spans partitions; each part looks back within itself, and its
first rows take what is missing from the last rows of the parts before, which are few:
only groups that open a partition can continue an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import Scratch


def lagged(df: DataFrame, key: str, order: list[str], value: str, depth: int, default: object = None, prefix: str = "prev", partitions: int | None = None) -> DataFrame:
    """``df`` with ``prev1`` .. ``prevN``: the values 1..depth rows before, within the key and order.

    ``order`` must tell the rows of a key apart, else ties fall either way.  Rows with a
    null key form one group.  ``default`` stands where there is no such row; a null value
    stays null.
    """
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = [F.col(c).alias(c) for c in df.columns]
    placed = df.repartitionByRange(n, key, *order).select(*kept, F.spark_partition_id().alias("_part"))
    # written, as a recomputed partition must hold the same rows
    scratch = Scratch(spark, "lagged")
    placed = scratch.write(placed, "placed")

    own = Window.partitionBy("_part", key).orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    rows = placed.withColumn("_rn", F.row_number().over(own))
    for k in range(1, depth + 1):
        rows = rows.withColumn(f"_lag{k}", F.lag(boxed, k).over(own))

    group = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"))
    # at most one row a part, and of each part's first and last groups few: written, so the planner knows their size
    opens = scratch.write(placed.groupBy("_part").agg(F.min(group).alias("_g")).select("_g").distinct(), "opens")
    back = Window.partitionBy("_part", key).orderBy(*[F.col(o).desc() for o in order])
    ends = placed.withColumn("_g", group).join(opens, "_g", "left_semi")
    ends = ends.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= depth)
    tails = ends.groupBy("_part", "_g").agg(F.sort_array(F.collect_list(F.struct("_back", boxed.alias("b")))).alias("_t"))
    tails = tails.select("_part", "_g", F.transform("_t", lambda x: x["b"]).alias("_t"))
    # nearest part first: what all earlier parts of the group end with
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    context = tails.select("_part", "_g", F.slice(F.flatten(F.reverse(F.collect_list("_t").over(before))), 1, depth).alias("_ctx"))

    context = scratch.write(context, "context")
    joined = rows.withColumn("_g", group).join(context, ["_part", "_g"], "left")

    def look(k: int) -> Column:
        place = F.lit(k) - F.col("_rn")
        outside = F.when(place >= 0, F.get("_ctx", place))
        found = F.coalesce(F.col(f"_lag{k}"), outside)
        return F.when(found.isNotNull(), found["v"]).otherwise(F.lit(default))

    return joined.select(*df.columns, *[look(k).alias(f"{prefix}{k}") for k in range(1, depth + 1)])
