import pytest

from lexiloom import profiles
from lexiloom.operators import rules
from lexiloom.plans import search as P

TOY = profiles.LanguageProfile("toy", lambda c, d: c, tuple("ptkneo"), tuple("eo"))
ROWS = [("L1", "pten", "pten", "a"), ("L2", "pto", "pto", " "), ("L3", "kten", "kten", "b"), ("L4", None, "x", "b"), (None, "oo", "oo", None)]
RULES = rules.compile_rules([{"id": "AAA-001", "input": "k", "output": "p", "dialects": ["x"], "name_en": "k to p"}], list("ptkneo"))


@pytest.fixture(scope="module")
def lexicon(spark):
    return P.prepare_lexicon(spark.createDataFrame(ROWS, "id string, headword string, ipa string, dialect string"), TOY)


@pytest.fixture(scope="module")
def results(spark, lexicon):
    queries = [(1, "pten"), (2, "pte"), (3, "pt-n"), (4, "oo"), (5, "kt-"), (6, "ptenn"), (7, "-en"), (8, "k")]
    got = P.search(spark.createDataFrame(queries, "qid int, query string"), lexicon, TOY, RULES).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append(r)
    return out


def test_lexicon_and_postings(lexicon):
    assert {r["id"] for r in lexicon.collect()} == {"L1", "L2", "L3", "oo"}
    assert {(r["kmer"], r["id"]) for r in P.postings(lexicon).collect()} == {("p t", "L1"), ("p t", "L2"), ("t n", "L1"), ("t n", "L3"), ("k t", "L3")}
    assert P.duplicate_ids(lexicon.unionByName(lexicon)).count() == 4


def test_full_form(results):
    assert [(r["id"], r["confidence"]) for r in results[1]] == [("L1", 1.0), ("L3", 0.75), ("L2", 0.5)]
    assert [r["match_type"] for r in results[1]] == ["Exact", "Rule-based", "Low-confidence"]
    assert results[1][0]["drawing"] == "query: p t e n\n       | | | |\nlemma: p t e n"
    assert results[1][1]["drawing"] == "query: p t e n\n       : | | |\nlemma: k t e n"
    assert results[1][2]["drawing"] == "query: p t e n\n       | | .\nlemma: p t o -"
    assert results[1][1]["dialect_attribution"] == "lemma dialect: b; query-compatible dialects: x"
    assert results[1][2]["dialect_attribution"] == "lemma dialect: unknown"


def test_paths_and_modes(spark, lexicon, results):
    assert {r["mode"] for r in results[2]} == {"Short-query"} and results[2][0]["id"] == "L1"
    assert results[3][0]["mode"] == "Partial-form" and results[3][0]["id"] == "L1"
    assert results[5][0]["id"] == "L3" and results[7][0]["path"].endswith("partial")
    assert results[4][0]["path"] == "proximity" and results[4][0]["id"] == "oo"
    q = P.prepare_queries(spark.createDataFrame([(8, "k"), (9, "e"), (10, "e-k")], "qid int, query string"), TOY)
    got = {(r["qid"], r["path"]) for r in P.candidates(q, lexicon).collect()}
    assert got == {(8, "unigram"), (9, "proximity"), (10, "unigram_partial")} and 8 not in results


def test_near_length_is_round_robin(spark):
    rows = [(1, f"x{i}", d, i) for i, d in enumerate([2, 0, 0, 1, 3, 1])]
    got = P.near_length(spark.createDataFrame(rows, "qid int, id string, delta int, seed_pos int")).orderBy("turn").collect()
    assert [r["id"] for r in got] == ["x1", "x3", "x0", "x2", "x5"]


def test_errors(spark, lexicon):
    with pytest.raises(ValueError):
        P.search(spark.createDataFrame([(1, "p")], "qid int, query string"), lexicon, TOY, results=0)
    for bad in (" ", "p-t-n", "-"):
        with pytest.raises(Exception):
            P.search(spark.createDataFrame([(1, bad)], "qid int, query string"), lexicon, TOY).collect()
    with pytest.raises(NotImplementedError):
        profiles.GREEK.to_ipa("x", "doric")


def test_empty(spark, lexicon):
    q = spark.createDataFrame([], "qid int, query string")
    assert P.search(q, lexicon, TOY).count() == 0
    assert P.search(spark.createDataFrame([(1, "pten")], "qid int, query string"), lexicon.limit(0), TOY).count() == 0


def test_profiles():
    assert {"ascii", "ancient_greek"} <= set(profiles.names())
    with pytest.raises(ValueError):
        profiles.register(profiles.ASCII)
    with pytest.raises(ValueError):
        profiles.get("none")


def test_stream_equals_batch(spark, lexicon, tmp_path):
    from lexiloom.streaming import lookup

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    q = spark.createDataFrame([(1, "pten"), (2, "kten")], "qid int, query string")
    q.write.parquet(src)
    lookup.search_stream(spark.readStream.schema("qid int, query string").parquet(src), lexicon, TOY, out, str(tmp_path / "cp"), ruleset=RULES).awaitTermination(120)
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], r["confidence"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(P.search(q, lexicon, TOY, RULES))
