"""Learning a substitution matrix from aligned pairs: column counts and log-odds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.align import global_alignment_udf
from lexiloom.session import Scratch, spread

# Fixed value: pairs with more phones on a side teach nothing and are counted apart.
LONGEST = 200


def pair_fate(left: str, right: str, longest: int | None = LONGEST) -> Column:
    """seen, skipped_empty or skipped_long: what becomes of a pair; no bound with ``longest`` None."""
    empty = (F.coalesce(F.size(left), F.lit(0)) <= 0) | (F.coalesce(F.size(right), F.lit(0)) <= 0)
    long = F.greatest(F.size(left), F.size(right)) > longest if longest is not None else F.lit(False)
    return F.when(empty, "skipped_empty").when(long, "skipped_long").otherwise("seen")


def pair_counters(pairs: DataFrame, left: str, right: str, weight: Column | None = None, longest: int | None = LONGEST) -> DataFrame:
    """(fate, n): how many pairs are aligned and how many are left out, and why."""
    w = weight if weight is not None else F.lit(1)
    return pairs.groupBy(pair_fate(left, right, longest).alias("fate")).agg(F.sum(w).cast("bigint").alias("n"))


def aligned_pairs(pairs: DataFrame, left: str, right: str, longest: int | None = LONGEST) -> DataFrame:
    """``pairs`` of token arrays with ``alignment``; those that ``pair_fate`` skips are left out.

    Equal pairs are aligned once each: callers group before and weigh after if they repeat.
    """
    return spread(pairs.where(pair_fate(left, right, longest) == "seen")).withColumn("alignment", global_alignment_udf()(left, right))


def column_counts(aligned: DataFrame, weight: Column | None = None) -> DataFrame:
    """(a, b, n): unordered phone pairs, and (a, null, n) insertions and deletions of a phone.

    A column of two gaps raises.
    """
    w = weight if weight is not None else F.lit(1)
    cols = aligned.select(w.alias("_w"), F.explode("alignment").alias("c")).select("_w", "c.q", "c.l")
    both = F.col("q").isNotNull() & F.col("l").isNotNull()
    none = F.col("q").isNull() & F.col("l").isNull()
    a = F.when(none, F.raise_error(F.lit("a column of two gaps")).cast("string")).when(both, F.least("q", "l")).otherwise(F.coalesce("q", "l"))
    return cols.groupBy(a.alias("a"), F.when(both, F.greatest("q", "l")).alias("b")).agg(F.sum("_w").alias("n"))


def log_odds(counts: DataFrame, smoothing: str = "laplace", alpha: float = 0.5, floor: float = -10.0, min_count: int = 0) -> DataFrame:
    """(a, b, n, score) over the whole alphabet's triangle a <= b; counts as from ``column_counts``.

    The alphabet is bounded (phones): the counts are written once, and their triangle is
    built by one join of that small table, whose size the planner knows.
    """
    counts = Scratch(counts.sparkSession, "counts").write(counts, "counts")
    add = {"laplace": 1.0, "lidstone": alpha, "floor": 0.0}[smoothing]
    pairs = counts.where("b is not null")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("k"))
    totals = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pair_total"))
    size = ends.agg(F.count("*").alias("m"))
    x, y = ends.select(F.col("p").alias("a"), F.col("k").alias("ka")), ends.select(F.col("p").alias("b"), F.col("k").alias("kb"))
    grid = x.join(y, F.col("a") <= F.col("b")).join(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    grid = grid.join(F.broadcast(totals)).join(F.broadcast(size)).withColumn("n", F.coalesce("n", F.lit(0)))
    q = (F.col("n") + add) / (F.col("pair_total") + add * F.col("m") * (F.col("m") + 1) / 2)
    pa, pb = F.col("ka") / (2 * F.col("pair_total")), F.col("kb") / (2 * F.col("pair_total"))
    expected = F.when(F.col("a") == F.col("b"), pa * pb).otherwise(2 * pa * pb)
    score = F.when((q > 0) & (expected > 0), F.log2(q / expected)).otherwise(F.lit(floor))
    return grid.where(F.col("n") >= min_count).select("a", "b", F.col("n").cast("bigint").alias("n"), score.alias("score"))


def matrix_violations(cells: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells (p1, p2, d) that break symmetry, completeness or the bounds 0..1, with the reason."""
    other = cells.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), F.col("d").alias("d2"))
    both = cells.join(other, ["p1", "p2"], "full")
    reason = (
        F.when(F.col("d").isNull() | F.col("d2").isNull(), "missing").when(F.abs(F.col("d") - F.col("d2")) > tolerance, "asymmetric")
        .when((F.col("p1") == F.col("p2")) & (F.col("d") != 0), "diagonal").when((F.col("d") < 0) | (F.col("d") > 1), "bounds")
    )
    return both.withColumn("reason", reason).where("reason is not null").select("p1", "p2", "reason")
