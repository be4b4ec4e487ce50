"""Evaluation analytics: splits, recall, rank profiles, paired tests, intervals, facets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bootstrap size and seed, split share, rank cut-offs.
RESAMPLES, SEED = 1000, 20260811
SPLIT_SHARE = 0.30
CUTS = (1, 5, 10, 20, 50)


def hash_fraction(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of SHA-256 of seed and key."""
    h = F.substring(F.sha2(F.concat(F.lit(seed), key.cast("string")), 256), 1, 13)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def document_split(docs: DataFrame, doc: str, size: str, seed: str = "split-1", share: float = SPLIT_SHARE, stratum: str | None = None, buckets: int = 4096) -> DataFrame:
    """(doc, split): documents in hash order are dev while the running size before them is below the share.

    The running sum is taken in two steps, over hash buckets and within one bucket, so that
    no stratum is one task's.
    """
    s = F.col(stratum) if stratum else F.lit("all")
    x = docs.select(F.col(doc).alias("_d"), F.col(size).alias("_n"), F.coalesce(s.cast("string"), F.lit("")).alias("_s"), hash_fraction(seed, F.col(doc)).alias("_h"))
    x = x.withColumn("_b", F.floor(F.col("_h") * buckets))
    sums = x.groupBy("_s", "_b").agg(F.sum("_n").alias("_bn"))
    upto = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_s", "_b", F.coalesce(F.sum("_bn").over(upto), F.lit(0)).alias("_before"), F.sum("_bn").over(Window.partitionBy("_s")).alias("_all"))
    within = Window.partitionBy("_s", "_b").orderBy("_h", "_d").rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(sums, ["_s", "_b"]).withColumn("_run", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return x.select(F.col("_d").alias(doc), F.when(F.col("_run") < share * F.col("_all"), "dev").otherwise("test").alias("split"))


def top_strata(docs: DataFrame, stratum: str, size: str, most: int = 20) -> DataFrame:
    """``docs`` with all but the ``most`` largest strata named other (``most`` bounds what is broadcast)."""
    top = docs.groupBy(stratum).agg(F.sum(size).alias("_n")).orderBy(F.desc("_n"), stratum).limit(most).select(F.col(stratum).alias("_top"))
    return docs.join(F.broadcast(top), F.col(stratum) == F.col("_top"), "left").withColumn(stratum, F.coalesce("_top", F.lit("other"))).drop("_top")


def capped_sample(rows: DataFrame, doc: str, key: str, per_doc: int, docs: int, seed: int = 7) -> DataFrame:
    """At most ``per_doc`` rows of each of ``docs`` documents, both drawn by hash."""
    chosen = rows.select(doc).distinct().orderBy(F.xxhash64(F.lit(seed), F.col(doc)), doc).limit(docs)
    rn = F.row_number().over(Window.partitionBy(doc).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.join(chosen, doc).withColumn("_rn", rn).where(F.col("_rn") <= per_doc).drop("_rn")


def index_percentile(values: Column, p: float) -> Column:
    """The element at ``int(n * p)`` of the sorted values; for values that are few, as cut-offs or candidate sizes."""
    a = F.array_sort(F.collect_list(values))
    return F.get(a, F.least(F.floor(F.size(a) * p), F.size(a) - 1).cast("int"))


def exact_index_percentile(df: DataFrame, value: str, ps: list[float]) -> DataFrame:
    """(p, value): index percentiles from value counts, so that only distinct values are ordered."""
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    total = hist.agg(F.sum("_c").alias("_n"))
    run = hist.withColumn("_hi", F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_v")))
    want = df.sparkSession.createDataFrame([(float(p),) for p in ps], "p double")
    at = want.join(F.broadcast(total)).select("p", F.least(F.floor(F.col("_n") * F.col("p")), F.col("_n") - 1).alias("_at"))
    return run.join(F.broadcast(at), (F.col("_at") < F.col("_hi")) & (F.col("_at") >= F.col("_hi") - F.col("_c"))).select("p", F.col("_v").alias("value"))


def recall(ranks: DataFrame, group: str = "split", rank: str = "rank", size: str = "n_cand", cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Hits at each cut-off per split and in all (a one-level rollup); a null rank is a miss."""
    hits = [F.sum(F.when(F.col(rank) < k, 1).otherwise(0)).alias(f"hit_{k}") for k in cuts]
    out = ranks.rollup(group).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col(size) == 0, 1).otherwise(0)).alias("empty"), *hits, F.count(rank).alias("hit_any"), F.grouping(group).alias("_g")
    )
    return out.withColumn(group, F.when(F.col("_g") == 1, "all").otherwise(F.col(group))).drop("_g")


def gold_ranks(cands: DataFrame, gold: DataFrame, key: list[str], lemma: str = "lemma", place: str = "place") -> DataFrame:
    """Per token of ``gold`` (key, gold): 0-based ``lenient`` and ``strict`` place of the first match, each null for none, and ``n_cand``.

    Lenient equality leaves out homograph digits, accents, breathings and case.
    """
    from lexiloom.functions.scalars import lemma_lenient, lemma_strict

    c = cands.select(*key, F.col(lemma).alias("_l"), F.col(place).alias("_p")).withColumns({"_ls": lemma_strict("_l"), "_ll": lemma_lenient("_l")})
    g = gold.select(*key, F.col("gold").alias("_g")).withColumns({"_gs": lemma_strict("_g"), "_gl": lemma_lenient("_g")})
    first = lambda a, b: F.min(F.when(F.col(a) == F.col(b), F.col("_p")))
    return g.join(c, key, "left").groupBy(*key).agg(first("_ll", "_gl").alias("lenient"), first("_ls", "_gs").alias("strict"), F.count("_p").alias("n_cand"))


def merged_slices(parts: list[DataFrame], key: list[str], same: list[str]) -> DataFrame:
    """Disjoint result slices as one table; a repeated ``key``, or slices unlike in ``same`` (stage, provenance), raise."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    kinds = both.agg(F.countDistinct(*[F.struct(F.col(c)) for c in same]).alias("_kinds"))
    twice = both.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_twice"))
    bad = F.when(F.col("_kinds") > 1, F.raise_error(F.lit("slices of unlike stage or provenance")).cast("string")).when(F.col("_twice") > 1, F.raise_error(F.lit("a key occurs twice")).cast("string"))
    return both.join(F.broadcast(kinds)).join(F.broadcast(twice)).where(bad.isNull()).drop("_kinds", "_twice")


def overlap_roles(left: DataFrame, right: DataFrame, key: str, role: str) -> DataFrame:
    """(key, role): the keys two collections share, with the role (dev, test, unused) each has in ``right``."""
    mine = left.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.col(key) != "").distinct()
    return mine.join(right.select(F.trim(F.col(key).cast("string")).alias(key), role).distinct(), key)


def rank_profile(ranks: DataFrame, doc: str = "doc", rank: str = "rank") -> DataFrame:
    """Unresolved share, rank median and p90 (by index), recall at the cut-offs, documents fully covered at 5 and 20."""
    per_doc = ranks.groupBy(doc).agg(*[F.bool_and(F.coalesce(F.col(rank) < k, F.lit(False))).alias(f"c{k}") for k in (5, 20)])
    cover = per_doc.agg(*[F.avg(F.col(f"c{k}").cast("int")).alias(f"doc_coverage_{k}") for k in (5, 20)])
    found = exact_index_percentile(ranks, rank, [0.5, 0.9])
    pct = found.agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("rank_median"), F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("rank_p90"))
    main = ranks.agg(
        F.count("*").alias("n"),
        (1 - F.count(rank) / F.count("*")).alias("unresolved"),
        *[F.avg(F.coalesce(F.col(rank) < k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in CUTS],
    )
    return main.join(F.broadcast(pct)).join(F.broadcast(cover))


def discordant(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(only_a, only_b): what McNemar's test needs."""
    return rows.agg(F.sum(F.when(F.col(a) & ~F.col(b), 1).otherwise(0)).alias("only_a"), F.sum(F.when(~F.col(a) & F.col(b), 1).otherwise(0)).alias("only_b"))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Exact two-sided binomial tail on the discordant pairs; 1 if there are none."""

    def one(a: int, b: int) -> float:
        n = int(a + b)
        if n == 0:
            return 1.0
        # term by term from the middle of the distribution, in logarithms
        k = int(min(a, b))
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(math.exp(x) for x in logs))

    return pd.Series([one(a, b) for a, b in zip(only_a, only_b, strict=True)])


def _poisson(hashes: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers, one row per hash, the same for the same seed, hash and place."""
    x = hashes[:, None] + (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(below, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def cluster_bootstrap(rows: DataFrame, doc: str, a: str, b: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Means of two systems and their difference with 95 % intervals over resampled documents.

    Documents are summed first.  A document's multiplicity in a resample is Poisson(1)
    drawn from a hash of seed, resample and document, so resampling is one aggregation
    without shuffling documents to a driver or holding them in one task.
    """
    docs = rows.groupBy(doc).agg(F.count("*").alias("n"), F.sum(F.col(a).cast("int")).alias("x"), F.sum(F.col(b).cast("int")).alias("y"))

    def totals(batches):
        rng_sum = np.zeros((resamples, 3))
        point = np.zeros(3)
        for pdf in batches:
            m = pdf[["n", "x", "y"]].to_numpy(float)
            point += m.sum(0)
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(h), 512):  # so many documents' draws are held at once
                rng_sum += _poisson(h[at : at + 512], resamples, seed).T @ m[at : at + 512]
        yield pd.DataFrame({"r": np.arange(-1, resamples), "n": np.r_[point[0], rng_sum[:, 0]], "x": np.r_[point[1], rng_sum[:, 1]], "y": np.r_[point[2], rng_sum[:, 2]]})

    parts = docs.select(F.xxhash64(F.col(doc).cast("string")).alias("h"), "n", "x", "y").mapInPandas(totals, "r int, n double, x double, y double")
    draws = parts.groupBy("r").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).where("n > 0")
    draws = draws.select("r", (F.col("x") / F.col("n")).alias("a"), (F.col("y") / F.col("n")).alias("b")).withColumn("diff", F.col("b") - F.col("a"))
    exprs = []
    for c in ("a", "b", "diff"):
        exprs.append(F.max(F.when(F.col("r") == -1, F.col(c))).alias(c))
        only = F.when(F.col("r") >= 0, F.col(c))
        exprs += [index_percentile(only, 0.025).alias(f"{c}_low"), index_percentile(only, 0.975).alias(f"{c}_high")]
    return draws.agg(*exprs)


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R², n, mean and spread of x, and the residual deviation."""
    got = df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("mean_x"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"),
    )
    return got.withColumn("residual_sd", F.when(F.col("n") > 2, F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2)))).drop("syy")


def prediction_half_width(x: Column, t: float = 1.96) -> Column:
    """Half width of the prediction interval at ``x``, over the columns of ``ols``."""
    return t * F.col("residual_sd") * F.sqrt(1 + 1 / F.col("n") + (x - F.col("mean_x")) ** 2 / F.col("sxx"))


def apply_facets(rows: DataFrame, facets: list[Column], keep_unknown: bool = True) -> DataFrame:
    """Drop on false; on unknown (null) keep or drop by policy."""
    cond = F.lit(True)
    for f in facets:
        cond = cond & F.coalesce(f, F.lit(keep_unknown))
    return rows.where(cond)


def zone(reachable: Column) -> Column:
    """confident where a named alternation reaches the candidate, else explore."""
    return F.when(reachable, "confident").otherwise("explore")


def zone_of_cost(cost: Column) -> Column:
    """The naive zone, from the cost alone: plain edit distance leaves a half."""
    return F.when(cost % 1.0 == 0.5, "explore").otherwise("confident")


def keep_equal(wanted: Column, found: Column) -> Column:
    """A facet that keeps on equality and is unknown where either side is."""
    return wanted == found


def keep_attested(histogram: Column, keys: Column) -> Column:
    """A facet that keeps what is attested under one of the keys; unknown without a histogram."""
    return F.when(F.size(histogram) > 0, F.exists(keys, lambda k: F.coalesce(F.try_element_at(histogram, k), F.lit(0).cast("bigint")) > 0))


def keep_initial(query_key: Column, candidate_key: Column) -> Column:
    """A facet on the first letter of the base keys; unknown for empty keys."""
    return F.when((query_key != "") & (candidate_key != ""), F.substring(query_key, 1, 1) == F.substring(candidate_key, 1, 1))


def measure_facets(rows: DataFrame, facets: list[Column], key: list[str], gold: str, keep_unknown: bool = True) -> DataFrame:
    """Candidates and gold candidates before and after the facets, and tokens that lost their gold."""
    ok = F.lit(True)
    for f in facets:
        ok = ok & F.coalesce(f, F.lit(keep_unknown))
    per = rows.withColumn("_ok", ok).groupBy(*key).agg(
        F.count("*").alias("_n"), F.sum(F.col("_ok").cast("int")).alias("_k"), F.bool_or(F.col(gold)).alias("_g"), F.bool_or(F.col(gold) & F.col("_ok")).alias("_h")
    )
    return per.agg(
        F.count("*").alias("tokens"), F.sum("_n").alias("candidates"), F.sum("_k").alias("kept"), F.sum(F.col("_g").cast("int")).alias("gold"),
        F.sum(F.col("_h").cast("int")).alias("gold_kept"), F.sum((F.col("_g") & ~F.col("_h")).cast("int")).alias("gold_lost"),
    )


def grouped_examples(rows: DataFrame, key: str, example: str, min_count: int = 2, most: int = 8) -> DataFrame:
    """(key, n, examples): groups of at least ``min_count`` rows with their first distinct examples.

    Examples are cut to ``most`` per partition before they are gathered, so no group is held whole.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(example))
    few = rows.select(key, example).distinct().withColumn("_rn", rn).where(F.col("_rn") <= most)
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return n.join(lists, key)


def vocabulary_coverage(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(n_words, n_known, coverage) of the distinct words."""
    mine = words.select(F.col(word).alias("_w")).where("_w is not null").distinct()
    known = vocabulary.select(F.col(word).alias("_w"), F.lit(1).alias("_k")).distinct()
    return mine.join(known, "_w", "left").agg(F.count("*").alias("n_words"), F.count("_k").alias("n_known")).withColumn("coverage", F.try_divide("n_known", "n_words"))


def nested_ceilings(rows: DataFrame, **tests: Column) -> DataFrame:
    """How many rows pass the first test, the first two, and so on: a reachability ceiling."""
    out, so_far = [F.count("*").alias("n")], F.lit(True)
    for name, c in tests.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        out.append(F.sum(so_far.cast("int")).alias(name))
    return rows.agg(*out)


def budget_prefix(files: DataFrame, order: str, size: str, budget: float, buckets: int = 1024) -> DataFrame:
    """Files in order until their running size reaches the budget, the one that reaches it included.

    Sizes are summed over ranges of the order first, so no task sorts all files.
    """
    ranged = files.repartitionByRange(min(buckets, 64), order).withColumn("_b", F.spark_partition_id())
    sums = ranged.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_b", before.alias("_before"))
    within = F.coalesce(F.sum(size).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sums), "_b").where(F.col("_before") < budget).withColumn("_run", F.col("_before") + within).where(F.col("_run") < budget).drop("_b", "_before", "_run")


def positional_join(left: DataFrame, right: DataFrame, at: str, same: list[str]) -> DataFrame:
    """Rows of equal place side by side; a missing place or a difference in ``same`` raises."""
    r = right.select(*[F.col(c).alias(f"{c}_right") for c in right.columns])
    both = left.join(r, F.col(at) == F.col(f"{at}_right"), "full")
    off = F.col(at).isNull() | F.col(f"{at}_right").isNull()
    for c in same:
        off = off | ~F.col(c).eqNullSafe(F.col(f"{c}_right"))
    checked = F.when(off, F.raise_error(F.lit("the two lists differ")).cast("string"))
    return both.where(checked.isNull()).drop(f"{at}_right", *[f"{c}_right" for c in same])


def evaluate_cases(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: matched headwords with their best rank, missing ones, and wrong hits that outrank an expected one.

    ``expected`` is (case_id, headword, acceptable), one row per acceptable form; ``hits`` (case_id,
    rank, headword).  If any headword is missing every wrong hit outranks it.
    """
    found = expected.join(hits.select("case_id", "rank", F.col("headword").alias("acceptable")), ["case_id", "acceptable"], "left")
    best = found.groupBy("case_id", "headword").agg(F.min("rank").alias("rank"))
    per = best.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("headword", "rank")))).alias("matched"),
        F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.col("headword")))).alias("missing"),
        F.max("rank").alias("_worst"),
    )
    wrong = hits.join(expected.select("case_id", F.col("acceptable").alias("headword")).distinct(), ["case_id", "headword"], "left_anti")
    outrank = wrong.join(per.select("case_id", "_worst", (F.size("missing") > 0).alias("_m")), "case_id").where(F.col("_m") | (F.col("rank") < F.col("_worst")))
    lists = outrank.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "headword"))).alias("outranking"))
    empty = F.array().cast("array<struct<rank:int,headword:string>>")
    return per.join(lists, "case_id", "left").select(
        "case_id", (F.size("missing") == 0).alias("all_matched"), "matched", "missing", F.coalesce("outranking", empty).alias("outranking")
    )


def exclusion_costs(pairs: DataFrame, policies: dict[str, DataFrame], key: list[str], size: str) -> DataFrame:
    """(policy, files, tokens, share): what each exclusion policy takes away."""
    total = pairs.agg(F.sum(size).alias("_t"))
    out = None
    for name, gone in policies.items():
        hit = pairs.join(gone.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("tokens")).withColumn("policy", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
    return out.join(F.broadcast(total)).select("policy", "files", "tokens", F.try_divide(F.col("tokens"), F.col("_t")).alias("share"))


def failure_bucket(hit: Column, reachable: Column, generated: Column) -> Column:
    """hit, unreachable, ranking or generation."""
    return F.when(hit, "hit").when(~reachable, "unreachable").when(generated, "ranking").otherwise("generation")


def relative_change(new: Column, base: Column) -> Column:
    return F.when(base > 0, (new - base) / base)


def latency_regressions(summary: DataFrame, baseline: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(metric, new, base, change, regressed) against the thresholds 10, 10 and 15 %."""
    limits = limits or {"mean": 0.10, "p95": 0.10, "max": 0.15}
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    both = summary.select("metric", F.col("value").alias("new")).join(baseline.select("metric", F.col("value").alias("base")), "metric")
    change = relative_change(F.col("new"), F.col("base"))
    return both.withColumn("change", change).withColumn("regressed", change > table[F.col("metric")])
