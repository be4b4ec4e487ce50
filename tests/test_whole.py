"""Queries that take their words from the tables, as the fixed words of the first queries cut them."""

import math
import os
import re

import pytest

from lexiloom.plans import reference_queries as R

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def words(spark, where="true"):
    return {r["word"] for r in R._words(R.table(spark, D, "documents").where(where)).distinct().collect()}


def test_joins_take_every_word_and_searches_every_row(spark):
    got = {r["query"] for r in R.QUERIES["collapse_join_all"](spark, D).collect()}
    assert got == words(spark)
    asked = words(spark, "doc_id % 20 = 0")
    assert len(asked) > len(R.QUERY_WORDS)
    assert {r["query"] for r in R.QUERIES["proximity_topk_all"](spark, D).collect()} == asked


def test_infix_patterns(spark):
    tokens = {r["word"]: r["tok"] for r in R._tokens(spark, D).collect()}
    cut = lambda x: re.findall("th|sh|ch|ph|[a-z]", x)
    patterns = {(w[0], w[-2:]) for w in words(spark, "doc_id % 20 = 0") if len(w) > 2}

    def full(l, r, tok):
        ends = [i + len(l) for i in range(len(tok) - len(l) + 1) if tok[i : i + len(l)] == l]
        return bool(ends) and any(tok[i : i + len(r)] == r for i in range(min(ends), len(tok) - len(r) + 1))

    want = {(f"{a}-{b}", w) for a, b in patterns for w, tok in tokens.items() if full([a], cut(b), tok)}
    assert {(r["query"], r["word"]) for r in R.QUERIES["wildcard_infix_all"](spark, D).collect()} == want


def test_ngrams_hold_words_of_every_script(spark, tmp_path):
    spark.createDataFrame([(1, "Ο λόγος für ΛΌΓΟΣ. e\u0301té")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["w1"]: r["count"] for r in R.QUERIES["word_freq_all"](spark, str(tmp_path)).collect()}
    assert got == {"<s>": 4, "</s>": 2, "ο": 1, "λόγοσ": 2, "für": 1, "été": 1}
    assert ("ο", "λόγοσ", "für") in {tuple(r)[:3] for r in R.QUERIES["ngrams_tri_all"](spark, str(tmp_path)).collect()}


def test_every_arm_of_the_backoff(spark, tmp_path):
    texts = [(1, "a b c. a b d"), (20, "a b c. x b c. b a. x y")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:3]: r["score"] for r in R.QUERIES["stupid_backoff_all"](spark, str(tmp_path)).collect()}
    total = 2 * 6  # two sentences of three words and three marks
    want = {("a", "b", "c"): 1 / 2, ("<s>", "<s>", "a"): 2 / 2, ("x", "b", "c"): 0.4 * 1 / 2, ("<s>", "b", "a"): 0.16 * 2 / total, ("<s>", "x", "y"): 0.064 / total}
    assert {k: got[k] for k in want} == {k: round(math.log(v), 6) for k, v in want.items()}


def test_every_language_is_split(spark, tmp_path):
    langs = ["en", " EN", "de", "fr", "el", "la", "it"]
    spark.createDataFrame([(i, x, 10) for i, x in enumerate(langs)], "doc_id long, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["split"] for r in R.QUERIES["doc_split_stratified_all"](spark, str(tmp_path)).collect()}
    assert sorted((got[0], got[1])) == ["dev", "test"] and {got[i] for i in range(2, 7)} == {"dev"}
