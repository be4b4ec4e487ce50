import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import catalogue, evaluation, fuzzy, labels, ladder, learn, ngrams


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j - 1] + (x != y), p[j] + 1, q[-1] + 1))
        p = q
    return p[-1]


@pytest.mark.parametrize("d", [1, 2])
def test_edit_distance_join(spark, d):
    rng = random.Random(d)
    left = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 18, 19, 20, 21, 22, 23, 40) for _ in range(3)})

    def mutate(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        return "".join(w)

    right = sorted({mutate(w) for w in left for _ in range(4)})
    a = spark.createDataFrame([(x,) for x in [*left, None, left[-1]]], "a string")
    b = spark.createDataFrame([(x,) for x in [*right, None]], "b string")
    got = {(r[0], r[1]): r[2] for r in fuzzy.edit_distance_join(a, b, "a", "b", d).collect()}
    assert got == {(x, y): lev(x, y) for x in left for y in right if lev(x, y) <= d}


def test_ladder(spark):
    collapse = lambda c: F.translate(c, "cqzy", "kksi")
    lex = spark.createDataFrame([("cat", 5), ("kat", 2), ("cats", 9), ("dog", 1), ("mat", 4)], "word string, freq long")
    q = spark.createDataFrame([("kat",), ("xyz",)], "query string")
    parts = ladder.generators(q, lex, collapse)
    got = {(r["query"], r["word"]): r["cost"] for r in ladder.union(parts).collect()}
    assert got == {("kat", "kat"): 0.0, ("kat", "cat"): 1.0, ("kat", "mat"): 1.5, ("kat", "cats"): 2.5}
    assert {(r["word"], r["stage"]) for r in ladder.cascade(parts).collect()} == {("kat", "exact")}
    assert [r["word"] for r in ladder.ranked(ladder.union(parts)).orderBy("rank").collect()] == ["kat", "cat", "mat", "cats"]


def test_log_odds_by_hand(spark):
    al = "array<struct<q:string,l:string>>"
    rows = [([("a", "a"), ("a", "b"), ("b", None)],), ([("b", "a"), (None, "c")],)]
    counts = learn.column_counts(spark.createDataFrame(rows, f"alignment {al}"))
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == {("a", "a"): 1, ("a", "b"): 2, ("b", None): 1, ("c", None): 1}
    got = {(r["a"], r["b"]): r["score"] for r in learn.log_odds(counts).collect()}
    pa, pb = 4 / 6, 2 / 6
    assert got["a", "b"] == pytest.approx(math.log2((3 / 6) / (2 * pa * pb))) and got["b", "b"] == pytest.approx(math.log2((1 / 6) / pb**2))
    floor = {(r["a"], r["b"]): r["score"] for r in learn.log_odds(counts, "floor").collect()}
    assert floor["b", "b"] == -10.0
    assert {(r["a"], r["b"]) for r in learn.log_odds(counts, min_count=2).collect()} == {("a", "b")}
    assert learn.log_odds(counts.limit(0)).count() == 0
    with pytest.raises(Exception):
        learn.column_counts(spark.createDataFrame([([(None, None)],)], f"alignment {al}")).collect()


def test_matrix_checks(spark):
    cells = spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.5), ("b", "a", 0.4), ("b", "b", 0.1), ("a", "c", 0.2), ("d", "d", 0.0)], "p1 string, p2 string, d double")
    got = {(r["p1"], r["p2"]): r["reason"] for r in learn.matrix_violations(cells).collect()}
    assert got == {("a", "b"): "asymmetric", ("b", "a"): "asymmetric", ("b", "b"): "diagonal", ("a", "c"): "missing", ("c", "a"): "missing"}


def test_ngrams_and_backoff(spark):
    s = spark.createDataFrame([(["a", "b"],), (["a", "c"],), ([],), (None,)], "t array<string>")
    uni, bi, tri = (ngrams.counts(s, "t", n) for n in (1, 2, 3))
    assert {r["w1"]: r["count"] for r in uni.collect()} == {"<s>": 4, "a": 2, "b": 1, "c": 1, "</s>": 2}
    assert {(r["w1"], r["w2"]): r["count"] for r in bi.collect()}["<s>", "a"] == 2
    q = spark.createDataFrame([("<s>", "a", "b"), ("x", "a", "b"), ("x", "y", "b"), ("x", "y", "z")], "w1 string, w2 string, w3 string")
    got = {(r["w1"], r["w2"], r["w3"]): r["score"] for r in ngrams.backoff(q, uni, bi, tri, F.lit(10)).collect()}
    # the context (<s>, a) was seen twice, a twice, b once in ten
    assert got["<s>", "a", "b"] == pytest.approx(math.log(1 / 2)) and got["x", "a", "b"] == pytest.approx(math.log(0.4 / 2))
    assert got["x", "y", "b"] == pytest.approx(math.log(0.16 / 10)) and got["x", "y", "z"] == pytest.approx(math.log(0.064 / 10))


def test_evaluation(spark):
    r = spark.createDataFrame([("d1", "dev", 0, 3), ("d1", "dev", 6, 9), ("d2", "test", None, 0), ("d3", "test", 1, 2)], "doc string, split string, rank int, n_cand int")
    got = {x["split"]: x.asDict() for x in evaluation.recall(r).collect()}
    assert (got["all"]["n"], got["all"]["hit_1"], got["all"]["hit_5"], got["all"]["hit_any"], got["all"]["empty"]) == (4, 1, 2, 3, 1)
    p = evaluation.rank_profile(r).first()
    assert (p["unresolved"], p["rank_median"], p["rank_p90"], p["doc_coverage_5"]) == (0.25, 1, 6, pytest.approx(1 / 3))
    m = spark.createDataFrame([(1, 9), (0, 0), (5, 5)], "only_a long, only_b long").select(evaluation.mcnemar_p("only_a", "only_b").alias("p")).collect()
    assert [round(x["p"], 6) for x in m] == [round(22 / 1024, 6), 1.0, 1.0]


def test_bootstrap_covers_and_is_stable(spark):
    rng = random.Random(1)
    rows = [(f"d{i % 60}", rng.random() < 0.5, rng.random() < 0.7) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc string, a boolean, b boolean")
    one = evaluation.cluster_bootstrap(df, "doc", "a", "b", resamples=200).first()
    assert one == evaluation.cluster_bootstrap(df.repartition(5), "doc", "a", "b", resamples=200).first()
    assert one["diff_low"] < one["diff"] < one["diff_high"] and one["diff_low"] > 0.1


def test_split_is_the_prefix_of_hash_order(spark):
    docs = spark.createDataFrame([(i, i % 7 + 1) for i in range(500)], "doc int, n int")
    got = evaluation.document_split(docs, "doc", "n", share=0.3).join(docs, "doc").collect()
    dev = sum(r["n"] for r in got if r["split"] == "dev")
    total = sum(r["n"] for r in got)
    assert 0.3 * total <= dev < 0.3 * total + 7 and len(got) == 500


def test_catalogue(spark):
    rows = spark.createDataFrame([(1, "x", ["p"]), (2, "y", ["p", "q"]), (3, "x", None)], "id int, cat string, d array<string>")
    assert [r["id"] for r in catalogue.matching(rows, {"cat": "x", "id": None}, {"d": "p"}).collect()] == [1]
    assert [(r["id"], r["total"]) for r in catalogue.page(rows, ["id"], 1, 1).collect()] == [(2, 3)]
    with pytest.raises(ValueError):
        catalogue.page(rows, ["id"], 0)
    assert catalogue.merge_lexicons(rows.drop("d"), rows.drop("d").limit(1)).count() == 3
    clash = spark.createDataFrame([(1, "other")], "id int, cat string")
    with pytest.raises(Exception):
        catalogue.merge_lexicons(rows.drop("d"), clash).collect()
    refs = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "id int, r string, n int")
    got = {r["id"]: [x["r"] for x in r["refs"]] for r in catalogue.enrich(rows, refs, "id", ["r"], ["n"]).collect()}
    assert got == {1: ["a", "b"], 2: [], 3: []}


def test_labels():
    assert labels.label_pair("λογος", "λωγος") == ["ο/ω quantity"] and labels.label_pair("αλος", "αλλος") == ["insertion (λ)"]
    assert labels.label_pair("ab", "ab") == [] and labels.label_pair("", "x") == ["insertion (x)"] and labels.label_pair("abcd", "a") == ["deletion (long)"]
    assert labels.label_pair("λογος", "ρογος") == ["gemination"] and labels.label_pair("κρινω", "κρεινω") == ["insertion (ε)"]
