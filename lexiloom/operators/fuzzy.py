"""Joins on similar words: edit distance through deletion neighbourhoods, and collapse keys.

Two words within distance d share a text after at most d deletions on either side, so short
words are equi-joined on their deletion variants.  Variants grow with the length's power,
so words above ``SHORT`` letters are joined on segments instead: cut into d + 1 segments,
a word shares at least one of them, shifted by at most d, with every word in reach.  All
pairs are checked by native ``levenshtein``; no length slice is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest word that is joined by deletion variants.
SHORT = 20


def deletions(word: Column | str, d: int) -> Column:
    """Texts left after at most ``d`` deletions, the word itself included.

    Deletions go from left to right, so each set of places is taken once; equal texts from
    equal neighbouring letters are left to the join's distinct.
    """
    w = F.col(word) if isinstance(word, str) else word
    level = F.array(F.struct(F.lit(1).alias("p"), w.alias("t")))
    parts = [F.array(w)]

    def shorter(x: Column) -> Column:
        places = F.when(F.length(x["t"]) >= x["p"], F.sequence(x["p"], F.greatest(F.length(x["t"]), x["p"]))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(places, lambda i: F.struct(i.alias("p"), F.concat(F.substring(x["t"], F.lit(1), i - 1), F.substring(x["t"], i + 1, F.length(x["t"]))).alias("t")))

    for _ in range(d):
        level = F.flatten(F.transform(level, shorter))
        parts.append(F.transform(level, lambda x: x["t"]))
    return F.concat(*parts)


def _cut(length: Column, k: Column, d: int) -> Column:
    return F.floor(k * length / (d + 1)).cast("int")


def segments(word: Column, d: int) -> Column:
    """(length, place, text) of the word's d + 1 segments."""
    n = F.length(word)

    def one(k: Column) -> Column:
        a, b = _cut(n, k, d), _cut(n, k + 1, d)
        return F.struct(n.alias("n"), k.alias("k"), F.substring(word, a + 1, b - a).alias("t"))

    return F.transform(F.sequence(F.lit(0), F.lit(d)), one)


def probes(word: Column, d: int) -> Column:
    """Every segment a word within distance d may share with this one."""
    n = F.length(word)
    grid = F.sequence(F.lit(0), F.lit((d + 1) * (2 * d + 1) * (2 * d + 1) - 1))

    def one(i: Column) -> Column:
        k, rest = i % (d + 1), F.floor(i / (d + 1)).cast("int")
        other, shift = n + rest % (2 * d + 1) - d, F.floor(rest / (2 * d + 1)).cast("int") - d
        a, b = _cut(other, k, d), _cut(other, k + 1, d)
        inside = (a + shift >= 0) & (b + shift <= n) & (other > 0)
        return F.when(inside, F.struct(other.alias("n"), k.alias("k"), F.substring(word, a + shift + 1, b - a).alias("t")))

    return F.array_distinct(F.filter(F.transform(grid, one), lambda x: x.isNotNull()))


def edit_distance_join(left: DataFrame, right: DataFrame, a: str, b: str, d: int) -> DataFrame:
    """Distinct pairs (a, b, dist) of the columns' words within distance ``d``; null words join nothing.

    Words are made distinct first, so a word that fills a third of all rows is one key.
    """
    x = left.select(a).where(F.col(a).isNotNull()).distinct()
    y = right.select(b).where(F.col(b).isNotNull()).distinct()
    xv = x.where(F.length(a) <= SHORT).select(a, F.explode(deletions(a, d)).alias("_v"))
    yv = y.where(F.length(b) <= SHORT + d).select(b, F.explode(deletions(b, d)).alias("_v"))
    xs = x.where(F.length(a) > SHORT).select(a, F.explode(segments(F.col(a), d)).alias("_v"))
    ys = y.where(F.length(b) > SHORT - d).select(b, F.explode(probes(F.col(b), d)).alias("_v"))
    pairs = xv.join(yv, "_v").select(a, b).unionByName(xs.join(ys, "_v").select(a, b)).distinct()
    return pairs.withColumn("dist", F.levenshtein(a, b, d)).where("dist >= 0")


def key_join(left: DataFrame, right: DataFrame, a: str, b: str, key) -> DataFrame:
    """Pairs of distinct words whose ``key(column)`` is equal."""
    x = left.select(a).distinct().withColumn("_k", key(F.col(a)))
    y = right.select(b).distinct().withColumn("_k", key(F.col(b)))
    return x.join(y, "_k").select(a, b)
