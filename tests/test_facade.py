import sqlite3

import pytest
from pyspark.sql import functions as F

from lexiloom.facade import Engine, Request, trusted
from lexiloom.operators import evaluation, ladder, notes, validation
from lexiloom.sources import documents as D

LEX = [("LSJ-00001", "λόγος", "lóɡos", "attic"), ("LSJ-00002", "λόφος", "lópʰos", "attic"), ("LSJ-00003", "θάλασσα", "tʰálassa", "attic")]
RULES = [{"id": "VOW-001", "name_en": "o lengthened", "input": "o", "output": "ɔː"}]


def test_requests():
    assert Request(" λόγος ").query == "λόγος"
    for bad in ({"query": " "}, {"query": "x" * 65}, {"query": "x", "max_candidates": 0}, {"query": "x", "dialect": "doric"}, {"query": "x", "language": "none"}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_engine(spark):
    lex = spark.createDataFrame(LEX, "id string, headword string, ipa string, dialect string")
    entries = spark.createDataFrame([("λώγος", "λόγος", ["λόγος"], "orthographic_correspondence", ["late_spelling"], "high")], "original string, normalized string, candidate_headwords array<string>, kind string, tags array<string>, confidence string")
    refs = spark.createDataFrame([("LSJ-00001", [("s1", "Short")])], "entry_id string, refs array<struct<source_id:string,short_citation:string>>")
    e = Engine(spark, lex, raw_rules=RULES, rule_version="1.0.0", entries=entries, sources=refs)
    hits = e.run(Request("λώγος", max_candidates=3)).orderBy("rank").collect()
    first = hits[0]
    assert first["headword"] == "λόγος" and list(first["applied_rules"]) == ["VOW-001"] and first["match_type"] == "Rule-based"
    assert [n["kind"] for n in first["notes"]] == ["orthographic_correspondence"] and first["bucket"] == "Supported" and "λώγος" in first["notes"][0]["message"]
    assert first["source_refs"][0]["short_citation"] == "Short" and first["summary"] == "1 named changes" and first["meta_ruleset_version"] == "1.0.0"
    assert all(list(h["notes"]) == [] for h in hits[1:])


def test_validation(spark):
    lex = spark.createDataFrame(
        [("LSJ-00001", "a", "a", "g", "noun", "feminine"), ("LSJ-00001", "a", "a", "g", "verb", None), ("x", " ", "a", None, "noun", None)],
        "id string, headword string, ipa string, gloss string, pos string, gender string",
    )
    got = {(r["subject"], r["reason"]) for r in validation.lexicon(lex).collect()}
    assert got == {("LSJ-00001", "repeated"), ("x", "id_pattern"), ("x", "no_headword"), ("x", "no_gloss"), ("x", "no_gender")}
    rules = spark.createDataFrame([("r1", ["d1", "dx"])], "id string, affected_dialects array<string>")
    dial = spark.createDataFrame([("d1", None, ["r1"]), ("d2", "d9", ["r9"])], "id string, parent string, rules array<string>")
    glos = spark.createDataFrame([("w", "d1", None), ("v", "zz", "r1")], "word string, dialect string, rule_id string")
    found = {(r["subject"], r["reason"]) for r in validation.catalogue(rules, dial, glos).collect()}
    assert found == {("d2", "unknown_parent"), ("d2", "unknown_rule"), ("r1", "unknown_dialect"), ("v", "unknown_dialect")}
    with pytest.raises(ValueError):
        validation.assert_valid(validation.lexicon(lex))
    validation.assert_valid(validation.lexicon(lex.limit(0)))


def test_matrix_completion():
    full = validation.complete_matrix({"p": {"b": 0.2}, "b": {}}, {"f": ("p", 0.1)})
    assert full == {"p": {"p": 0.0, "b": 0.2, "f": 0.1}, "b": {"p": 0.2, "b": 0.0, "f": 0.2}, "f": {"p": 0.1, "b": 0.2, "f": 0.0}}
    with pytest.raises(ValueError):
        validation.complete_matrix({"p": {}, "t": {}})


def test_cases_and_positional_join(spark):
    exp = spark.createDataFrame([("c1", "a", "a"), ("c1", "a", "a2"), ("c1", "b", "b"), ("c2", "z", "z")], "case_id string, headword string, acceptable string")
    hits = spark.createDataFrame([("c1", 1, "x"), ("c1", 2, "a2"), ("c1", 3, "b"), ("c1", 4, "y"), ("c2", 1, "q")], "case_id string, rank int, headword string")
    got = {r["case_id"]: r for r in evaluation.evaluate_cases(exp, hits).collect()}
    assert got["c1"]["all_matched"] and [(x["headword"], x["rank"]) for x in got["c1"]["matched"]] == [("a", 2), ("b", 3)] and [x["headword"] for x in got["c1"]["outranking"]] == ["x"]
    assert not got["c2"]["all_matched"] and list(got["c2"]["missing"]) == ["z"] and [x["headword"] for x in got["c2"]["outranking"]] == ["q"]
    a = spark.createDataFrame([(0, "x"), (1, "y")], "at int, k string")
    assert evaluation.positional_join(a, a, "at", ["k"]).count() == 2
    with pytest.raises(Exception):
        evaluation.positional_join(a, a.limit(1), "at", ["k"]).collect()


def test_more_evaluation(spark):
    files = spark.createDataFrame([(f"f{i:03}", 10) for i in range(50)], "f string, n int")
    assert sorted(r["f"] for r in evaluation.budget_prefix(files, "f", "n", 95).collect()) == [f"f{i:03}" for i in range(10)]
    w = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "word string")
    assert evaluation.vocabulary_coverage(w, spark.createDataFrame([("a",)], "word string")).first()["coverage"] == 0.5
    g = spark.createDataFrame([("x", f"e{i}") for i in range(20)] + [("y", "e")], "k string, e string")
    row = evaluation.grouped_examples(g, "k", "e").collect()
    assert [(r["k"], r["n"], len(r["examples"])) for r in row] == [("x", 20, 8)]
    c = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert tuple(evaluation.nested_ceilings(c, first=F.col("a"), second=F.col("b")).first()) == (3, 2, 1)
    m = spark.createDataFrame([(1, True, None), (1, False, True), (2, True, False)], "t int, gold boolean, f boolean")
    assert evaluation.measure_facets(m, [F.col("f")], ["t"], "gold").first().asDict() == {"tokens": 2, "candidates": 3, "kept": 2, "gold": 2, "gold_kept": 1, "gold_lost": 1}
    h = spark.createDataFrame([({"1": 3, "2": 1},), ({},), (None,)], "h map<string,bigint>")
    assert [r[0] for r in h.select(ladder.share(F.col("h"), F.array(F.lit("1"), F.lit("9")))).collect()] == [0.75, 0.0, 0.0]
    assert [r[0] for r in h.select(evaluation.keep_attested(F.col("h"), F.array(F.lit("9")))).collect()] == [False, None, None]
    p = {"corpus": spark.createDataFrame([("f001",)], "f string")}
    assert evaluation.exclusion_costs(files, p, ["f"], "n").first().asDict() == {"policy": "corpus", "files": 1, "tokens": 10, "share": 0.02}
    lat = evaluation.latency_regressions(spark.createDataFrame([("mean", 1.2), ("p95", 1.0)], "metric string, value double"), spark.createDataFrame([("mean", 1.0), ("p95", 1.0)], "metric string, value double"))
    assert {r["metric"]: r["regressed"] for r in lat.collect()} == {"mean": True, "p95": False}


def test_prose(spark):
    df = spark.createDataFrame([("a", "b", [("R", "x", "y")], 0.25), ("a", "b", [], 0.5)], "s string, t string, st array<struct<rule_id:string,input:string,output:string>>, d double")
    got = [r[0] for r in df.select(notes.prose(F.col("s"), F.col("t"), F.col("st"), F.col("d"))).collect()]
    assert got == ["/a/ becomes /b/ by R /x/ to /y/ (distance 0.250).", "/a/ and /b/ differ by 0.500; no rule applies."]


def test_paths_and_more_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "x.yaml"
    f.write_text("entries:\n- {original: λώγος, normalized: λόγος, kind: beginner_aid, tags: [], reviewed_at: 2024-01-02}\n")
    assert trusted(f, [tmp_path / "in"]) == f.resolve()
    (tmp_path / "out.yaml").write_text("x")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out.yaml")
    with pytest.raises(ValueError):
        trusted(tmp_path / "in" / "link", [tmp_path / "in"])
    row = D.orthographic_entries(spark, f).first()
    assert row["romanization"] == "logos" and list(row["candidate_headwords"]) == ["λόγος"] and row["reviewed_at"].year == 2024
    db = str(tmp_path / "l.db")
    con = sqlite3.connect(db)
    con.execute("create table lookup(form text, lemma text)")
    con.executemany("insert into lookup values (?, ?)", [(f"f{i}", f"l{i % 7}") for i in range(1000)])
    con.commit()
    got = D.sqlite_table(spark, db, "lookup", "form string, lemma string", 8)
    assert got.count() == 1000 and got.select("form").distinct().count() == 1000
