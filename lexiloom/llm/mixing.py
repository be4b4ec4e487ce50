"""Mixing sources to target weights (p7).

Sizes (tokens, unless another column is named) are summed per source.  A budget, by
default all that the target sources hold, is filled like vessels with water: each source
takes its share of it, but never more than ``max_repeats`` times what it has; what a
source at that bound leaves goes to the others in proportion to their shares.  A
source's rate is what it takes over what it has.  A document is emitted floor(rate)
times plus once more with probability equal to the fraction, drawn from a hash of its
id.  ``exact_budget`` is the largest budget that leaves no source at its bound, for
callers who would rather have a smaller mix than miss a share.

Everything per document stays distributed; only the target table's rows, joined with
one sum per source, shape the rates.

Defined results: sources without content or with share 0 give nothing and the other
shares are scaled to sum to 1; documents of sources without a target, or without a
source, are left out; null ids draw as one id; documents of null or no size are drawn
like others of their source; a budget beyond what all bounds allow gives all of that.
``targets`` names each source once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.tokens import VOCABULARY, with_token_counts
from lexiloom.session import rows_within

SEED = 20_240_501
#: A target table up to this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_TARGETS = 100_000


def _reachable(counted: DataFrame, targets: DataFrame, size: str) -> DataFrame:
    """Targets with ``tokens`` and ``documents`` available and the ``share`` among sources that have any."""
    sums = counted.groupBy("source").agg(F.sum(size).cast("double").alias("tokens"), F.count("*").alias("documents"))
    t = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").na.fill(0, ["tokens", "documents"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    # one partition: as many rows as there are targets
    return t.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(Window.partitionBy())))


def exact_budget(counted: DataFrame, targets: DataFrame, size: str = "n_tokens") -> float:
    """The largest mix in which every source that has documents gets its share; 0 without any."""
    t = _reachable(counted, targets, size)
    return t.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share"))).first()[0] or 0.0


def rates(counted: DataFrame, targets: DataFrame, budget: float | None = None, size: str = "n_tokens") -> DataFrame:
    """Targets with ``tokens``, ``documents``, ``share``, ``rate`` and the share ``reachable`` within the bounds."""
    t = _reachable(counted, targets, size).withColumn("_cap", F.when(F.col("share").isNotNull(), F.col("max_repeats") * F.col("tokens")))
    t = t.withColumn("_full_at", F.col("_cap") / F.col("share"))
    every = Window.partitionBy()
    want: Column = F.lit(float(budget)) if budget is not None else F.sum(F.when(F.col("share").isNotNull(), F.col("tokens"))).over(every)
    # vessels in the order in which they fill: before each, what the full ones hold and the shares that still rise
    order = Window.orderBy(F.asc_nulls_last("_full_at"), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(want - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.sum("share").over(onward))
    t = t.withColumn("_level", F.when(F.col("share").isNotNull(), level))
    level = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "source", "_level"))).over(every)["_level"]
    # no level: all vessels are full
    take = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.greatest(level, F.lit(0.0)) * F.col("share")))
    t = t.withColumn("_take", F.coalesce(take, F.lit(0.0)))
    rate = F.when(F.col("_take") >= F.col("_cap"), F.col("max_repeats").cast("double")).otherwise(F.try_divide("_take", "tokens"))
    return t.select(
        "source", "target_share", "max_repeats", "tokens", "documents", "share", F.coalesce(rate, F.lit(0.0)).alias("rate"),
        F.coalesce(F.try_divide(F.col("_take"), F.sum("_take").over(every)), F.lit(0.0)).alias("reachable"),
    )


def draw(seed: int, ident: Column | str) -> Column:
    """A number in [0, 1) from the seed and an id, the same on every run: 52 bits of a digest."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(counted: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = SEED, budget: float | None = None, size: str = "n_tokens") -> DataFrame:
    """(id, source, size, copy): one row for each time a document is used."""
    r = rates(counted, targets, budget, size).select("source", "rate").where("rate > 0")
    r = F.broadcast(r) if rows_within(targets, BROADCAST_TARGETS) else r
    copies = F.floor("rate") + F.when(draw(seed, id_col) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    used = counted.select(id_col, "source", size).join(r, "source").withColumn("_n", copies.cast("int")).where("_n > 0")
    return used.select(id_col, "source", size, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def shares(mixed: DataFrame, counted: DataFrame, targets: DataFrame, budget: float | None = None, size: str = "n_tokens") -> DataFrame:
    """Per target: rate, documents and size used, and the share reached beside the target and the reachable one."""
    got = mixed.groupBy("source").agg(F.count("*").alias("used"), F.sum(size).alias("used_tokens"), F.max("copy").alias("most_repeats"))
    out = rates(counted, targets, budget, size).join(got, "source", "left").na.fill(0, ["used", "used_tokens", "most_repeats"])
    return out.select(
        "source", "target_share", "max_repeats", F.col("tokens").cast("bigint").alias("tokens"), "documents", "share", "rate", "used", "used_tokens", "most_repeats", "reachable",
        F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0)).alias("actual_share"),
    )


def counted(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return with_token_counts(documents, ["doc_id", "source"], "text", "n_tokens", path)
