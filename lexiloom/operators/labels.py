"""Alternation labels of spelling pairs and their smoothed probabilities."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.unicode import nfd

# Named alternations and what may stand on either side, tried in order; None is any letter, once or doubled.
ALTERNATIONS = (
    ("itacism ει/ι", ("ει", "ι")), ("itacism η/ι/ει", ("η", "ι", "ει", "ῃ")), ("itacism οι/υ/ι", ("οι", "υ", "ι")), ("ο/ω quantity", ("ο", "ω")), ("ε/αι", ("ε", "αι")),
    ("nasal assimilation", ("ν", "μ", "γ")), ("voicing κ/γ π/β τ/δ", ("κ", "γ", "π", "β", "τ", "δ")), ("σ/ζ", ("σ", "ζ")), ("gemination", None), ("αυ/α ευ/ε", ("αυ", "α", "ευ", "ε", "ου", "ο", "υ")),
)
SMOOTHING = 0.5


def letters(text: Column | str) -> Column:
    """What labels compare: letters without their marks, in lower case, final sigma kept."""
    return F.lower(F.regexp_replace(nfd(text), r"[^\p{L}]+", ""))


def _side(x: str, allowed: tuple[str, ...] | None) -> bool:
    return x in allowed if allowed is not None else len(x) == 1 or (len(x) == 2 and x[0] == x[1])


def label_pair(a: str, b: str) -> list[str]:
    """One label for each stretch where two letter strings differ, by the standard library's matcher."""
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op == "equal":
            continue
        x, y = a[i:j], b[k:m]
        named = next((name for name, sides in ALTERNATIONS if _side(x, sides) and _side(y, sides)), None)
        if named is None and op != "replace":
            part, kind = (y, "insertion") if op == "insert" else (x, "deletion")
            named = f"{kind} ({part})" if len(part) <= 2 else f"{kind} (long)"
        out.append(named or "other substitution")
    return out


def alternations(a: Column, b: Column) -> Column:
    """ARRAY<STRING> of the labels between two spellings; null if either is null.  Equal pairs of a batch are compared once."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {(p, q): label_pair(p, q) for p, q in set(zip(x, y, strict=True)) if p is not None and q is not None}
        return pd.Series([known.get(pq) for pq in zip(x, y, strict=True)])

    return run(letters(a), letters(b))


def category(labels: Column) -> Column:
    """One name for a pair: its labels, sorted and joined; many or none have names of their own."""
    joined = F.array_join(F.array_sort(F.array_distinct(labels)), " + ")
    return F.when(F.size(labels) == 0, "accent/breathing only").when(F.size(labels) > 2, "multiple alternations").otherwise(joined)


def category_counts(rows: DataFrame, category: str, failed: Column, capitalised: Column) -> DataFrame:
    """(category, n, failed, capitalised): how often each category occurs, fails, and belongs to a capitalised lemma."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    flags = rows.select(category, failed.alias("_f"), capitalised.alias("_c"))
    return flags.groupBy(category).agg(F.count("*").alias("n"), count(F.col("_f")).alias("failed"), count(F.col("_c")).alias("capitalised"))


def probabilities(labelled: DataFrame, column: str = "labels") -> DataFrame:
    """(label, n, p): add-0.5 smoothed share of each label."""
    n = labelled.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    p = (F.col("n") + SMOOTHING) / (F.col("_t") + SMOOTHING * F.col("_k"))
    return n.join(F.broadcast(whole)).select("label", "n", F.round(p, 9).alias("p"))


def cost(labels: Column, p: Column) -> Column:
    """Sum of -log p over labels, given the map of probabilities."""
    return F.aggregate(labels, F.lit(0.0), lambda acc, x: acc - F.log(F.coalesce(p[x], F.lit(1e-6))))
