"""Candidate generation ladder: exact key, collapsed key, fuzzy on either; union and cascade.

Costs: exact 0, collapse rules 1, rules and distance d 2 + d, plain distance d 0.5 + d (at
most ``BLIND_KEYS`` keys a word).  A candidate keeps its smallest cost tuple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators import fuzzy
from lexiloom.session import Scratch

BLIND_KEYS = 300


def generators(queries: DataFrame, lexicon: DataFrame, collapse, d: int = 2) -> dict[str, DataFrame]:
    """Per generator (query, word, cost, freq); ``queries`` has query, ``lexicon`` word and freq.

    Both are written once, as every generator reads them.
    """
    scratch = Scratch(queries.sparkSession, "ladder")
    queries, lexicon = scratch.write(queries.select("query"), "queries"), scratch.write(lexicon.select("word", "freq"), "lexicon")
    freq = lexicon.select("word", "freq")
    exact = queries.join(freq, F.col("query") == F.col("word")).select("query", "word", F.lit(0.0).alias("cost"), "freq")
    rules = fuzzy.key_join(queries, lexicon, "query", "word", collapse).join(freq, "word").select("query", "word", F.lit(1.0).alias("cost"), "freq")
    qk = queries.select("query", collapse(F.col("query")).alias("qk"))
    lk = lexicon.select("word", "freq", collapse(F.col("word")).alias("lk"))
    near = fuzzy.edit_distance_join(qk, lk, "qk", "lk", 1).where("dist = 1")
    both = qk.join(near, "qk").join(lk, "lk").select("query", "word", (F.lit(2.0) + F.col("dist")).alias("cost"), "freq")
    blind = fuzzy.edit_distance_join(queries, lexicon, "query", "word", d).where("dist > 0").join(freq, "word")
    rn = F.row_number().over(Window.partitionBy("query").orderBy("dist", F.desc("freq"), "word"))
    blind = blind.withColumn("_rn", rn).where(F.col("_rn") <= BLIND_KEYS).select("query", "word", (F.lit(0.5) + F.col("dist")).alias("cost"), "freq")
    return {"exact": exact, "rules": rules, "rules_fuzzy": both, "blind": blind}


def union(parts: dict[str, DataFrame], use: tuple[str, ...] = ("exact", "rules", "rules_fuzzy", "blind")) -> DataFrame:
    """(query, word, cost, freq): every generator's candidates, each at its smallest cost."""
    out = parts[use[0]]
    for name in use[1:]:
        out = out.unionByName(parts[name])
    best = out.groupBy("query", "word").agg(F.min(F.struct("cost", (-F.col("freq")).alias("nf"))).alias("best"))
    return best.select("query", "word", "best.cost", (-F.col("best.nf")).alias("freq"))


def cascade(parts: dict[str, DataFrame], stages: tuple[str, ...] = ("exact", "rules", "rules_fuzzy", "blind")) -> DataFrame:
    """Candidates of the first stage that gives a query any."""
    out = None
    for name in stages:
        rows = parts[name].withColumn("stage", F.lit(name))
        if out is not None:
            rows = rows.join(out.select("query").distinct(), "query", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def lemma_candidates(cands: DataFrame, forms: DataFrame, key: str = "word") -> DataFrame:
    """Candidate keys led to lemmas: (query, lemma, cost, freq, source_key, place) by the forms that share a key.

    ``forms`` is (form, key, lemma, lang, lemma_freq); a key may have several forms and a form
    several lemmas.  Forms of the language itself come before those of all, and of the keys
    that lead to one lemma the cheapest stays, with its key as ``source_key``.
    """
    own = F.when(F.col("lang") == "grc", 0).otherwise(1)
    led = cands.select("query", F.col(key).alias("source_key"), "cost", "freq").join(forms.select(F.col("key").alias("source_key"), "form", "lemma", own.alias("foreign"), "lemma_freq"), "source_key")
    best = led.groupBy("query", "lemma").agg(F.min(F.struct("cost", "foreign", (-F.col("freq")).alias("nf"), "source_key", "form")).alias("b"), F.max("lemma_freq").alias("lemma_freq"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("b.cost", "b.foreign", "b.nf", F.desc("lemma_freq"), "lemma")) - 1
    return best.select("query", "lemma", "b.cost", (-F.col("b.nf")).alias("freq"), "lemma_freq", "b.source_key", place.alias("place"))


def ranked(cands: DataFrame, *order: Column) -> DataFrame:
    """``rank`` from 0 by the given order, by default cost, then frequency, then word."""
    keys = order or (F.col("cost"), F.desc("freq"), F.col("word"))
    return cands.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*keys)) - 1)


# --- re-rankers: Column expressions over a candidate table ------------------------


def additive_score(form_freq: Column, lemma_freq: Column, cost: Column, bonus: Column | float = 0.0, penalty: Column | float = 0.0) -> Column:
    """log1p(form) + 0.5 log1p(lemma) - 3 cost, plus a bonus, minus a penalty."""
    return F.log1p(form_freq) + 0.5 * F.log1p(lemma_freq) - 3 * cost + bonus - penalty


def share(histogram: Column, keys: Column, total: Column | None = None) -> Column:
    """Share of a MAP<STRING, BIGINT> histogram that falls on the given keys; 0 for null or empty."""
    hit = F.aggregate(keys, F.lit(0).cast("bigint"), lambda acc, k: acc + F.coalesce(F.try_element_at(histogram, k), F.lit(0).cast("bigint")))
    whole = total if total is not None else F.aggregate(F.map_values(histogram), F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    return F.when(F.size(histogram) > 0, hit / F.greatest(whole, F.lit(1))).otherwise(0.0)


def pos_penalty(wanted: Column, found: Column, penalty: float = 6.0) -> Column:
    """The penalty where both parts of speech are known and differ: 6 for a sure tag, 1.5 for a tagger's."""
    return F.when(wanted != found, penalty).otherwise(0.0)


#: Weights of the century, dialect and genre shares and the penalty's factor by re-ranker.
RERANKERS = {"R1": (0, 0, 0, 0), "R2": (2, 0, 0, 0), "R3": (0, 2, 0, 0), "R4": (0, 0, 2, 0), "R5": (0, 0, 0, 1), "R6": (2, 1, 1, 0), "R7": (2, 1, 1, 1)}


def rerank_order(name: str, cost: Column, form_freq: Column, lemma_freq: Column, century: Column, dialect: Column, genre: Column, penalty: Column) -> tuple[Column, ...]:
    """Sort keys of a re-ranker: R0 cost first, then frequencies; the others one additive score."""
    if name == "R0":
        return (cost.asc(), form_freq.desc(), lemma_freq.desc())
    a, b, c, d = RERANKERS[name]
    return (additive_score(form_freq, lemma_freq, cost, a * century + b * dialect + c * genre, d * penalty).desc(),)


def reachable_by_rule(variants: Column, key: Column, source_collapsed: Column) -> Column:
    """Whether the alternations could have produced the source: its collapsed key is a variant of the
    query's, or one edit from the query's collapsed key.  The cost alone cannot tell, as it is a minimum."""
    return F.array_contains(variants, source_collapsed) | (F.levenshtein(source_collapsed, key, 1) >= 0)


def lm_order(cost: Column, form_freq: Column, lemma_freq: Column, lm: Column, weight: float = 2.0) -> tuple[Column, ...]:
    """Language-model re-ranking: cost, then frequency and model, then lemma frequency."""
    return (cost.asc(), (F.log1p(form_freq) + weight * lm).desc(), lemma_freq.desc())


def alternation_order(kind: str, cost: Column, form_freq: Column, lemma_freq: Column, alt: Column, weight: float = 0.2) -> tuple[Column, ...]:
    """A1 before frequency, A2 in place of cost, A4 after frequency, A5 blended with cost."""
    return {
        "A1": (cost.asc(), alt.asc(), form_freq.desc(), lemma_freq.desc()),
        "A2": (alt.asc(), form_freq.desc(), lemma_freq.desc()),
        "A4": (cost.asc(), form_freq.desc(), lemma_freq.desc(), alt.asc()),
        "A5": ((cost + weight * alt).asc(), form_freq.desc(), lemma_freq.desc()),
    }[kind]


def noisy_label(key: Column, label: Column, others: list[str], error: float = 0.10, seed: int = 7) -> Column:
    """A label flipped for a fixed share of keys, the same way every time."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000.0
    wrong = F.filter(F.array(*[F.lit(o) for o in others]), lambda o: o != label)
    pick = F.get(wrong, F.pmod(F.xxhash64(F.lit(seed + 1), key), F.greatest(F.size(wrong), F.lit(1))).cast("int"))
    return F.when((h < error) & (F.size(wrong) > 0), pick).otherwise(label)
