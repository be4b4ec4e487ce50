import json

import pytest

from lexiloom.sources import documents as D
from lexiloom.sources import sinks
from lexiloom.sources import xml as X

EPIDOC = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><idno type="other">9</idno><idno type="TM">{tm}</idno></teiHeader><text><body><ab>
<choice><reg>λόγ<hi>ος</hi></reg><orig>λώγος</orig></choice> word<lb n="1" break="no"/>part <gap/> after
<choice><orig>a</orig><orig>b</orig><reg>c</reg></choice><choice><orig> </orig><reg/></choice></ab></body></text></TEI>"""


@pytest.fixture()
def xml_dir(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "60001.xml").write_text(EPIDOC.format(tm="123"))
    (tmp_path / "x60002y7.xml").write_text(EPIDOC.format(tm=" "))
    (tmp_path / "bad.xml").write_text("<TEI><choice>")
    (tmp_path / "evil.xml").write_text('<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')
    return str(tmp_path)


def test_choices(spark, xml_dir, tmp_path):
    f = X.files(spark, xml_dir)
    got = {(r["tm_id"], r["original"], r["regularized"], r["pair_index"]) for r in X.choices(f).collect()}
    assert got == {("123", "λώγος", "λόγος", 0), ("60002", "λώγος", "λόγος", 0)}
    assert X.failures(f).count() == 2
    (tmp_path / "torn.xml").write_text('<TEI xmlns="x"><teiHeader><idno type="TM">77</idno><text><p><choice><reg>νό&amp;μου</reg><orig>νομου</orig></choice></body></text></TEI>')
    torn = X.files(spark, xml_dir, "torn.xml")
    assert [tuple(r)[1:] for r in X.choices(torn).collect()] == [("νομου", "νό&μου", "77", 0)] and X.failures(torn).count() == 1


def test_running_text(spark, xml_dir):
    got = [r["text"] for r in X.running_text(X.files(spark, xml_dir, "60001.xml")).orderBy("n").collect()]
    assert got == ["λόγος wordpart", "after c"]


def test_treebank(spark, tmp_path):
    (tmp_path / "t.xml").write_text(
        '<treebank><document_meta name="doc1" date_not_before="100"/><sentence id="1">'
        '<word id="1" form_orig="λόγος" form_reg="λόγος" lemma_reg="λόγος|num:1|" postag_reg="n" lang="grc"/>'
        '<word id="2" form_orig="λώγος" form_reg="λόγος" lemma_reg="λόγος" lemma_orig="λόγος" postag_reg="n"/>'
        '<word id="3" form_orig="." form_reg="." lemma_reg="." postag_reg="u"/><word id="4" form_orig="[λο]" form_reg="λο" lemma_reg="λο" postag_reg="n"/>'
        '<word id="5" form_orig="verbum" form_reg="verbum" lemma_reg="verbum" postag_reg="n" lang="lat"/></sentence></treebank>'
    )
    got = [(r["doc"], r["wid"], r["lemma_gold"], r["stratum"]) for r in X.treebank(X.files(spark, str(tmp_path))).orderBy("wid").collect()]
    assert got == [("doc1", "1", "λόγος", "clean"), ("doc1", "2", "λόγος", "variant_ortho")]


ENTRIES = """<d>
<entryFree id="n7" key="lo/gos" type="main"><orth extent="full" lang="greek">lo/gos</orth>, <gen lang="greek">o(</gen>, <sense><tr>word</tr>, <tr>reason</tr></sense><sense><tr>other</tr></sense></entryFree>
<entryFree id="n7" key="a)/llo"><gen>o(</gen><sense><tr>again</tr></sense></entryFree>
<entryFree id="n8" key="a)/llo"><orth lang="greek">a)/llo</orth></entryFree>
<entryFree id="n9" key="kalo/s2"><orth lang="greek">kalo/s</orth>, <itype>h/</itype>, <itype>o/n</itype>, <sense><tr>fair</tr></sense></entryFree>
<entryFree id="n10" key="lu/w"><orth lang="greek">lu/w</orth><sense><tns>fut.</tns> <tr>loose</tr></sense></entryFree>
<entryFree id="n11" key="kalw=s"><orth lang="greek">kalw=s</orth><sense><tr>well</tr></sense></entryFree>
<entryFree id="n12" key="ai)/"><orth lang="greek">ai)/</orth>, Dor. Conj., <sense><tr>if</tr></sense></entryFree>
<entryFree id="n13" key="ei)"><orth lang="greek">ei)</orth>, <sense>Conj., <tr>if</tr></sense></entryFree>
<entryFree id="n14" key="*)" type="main"><orth lang="greek">o(/s</orth>, <pos>Pron.</pos> <sense><tr>who</tr></sense></entryFree>
<entryFree id="n15" key="trei=s"><orth lang="greek">trei=s</orth><sense><tr>%s</tr></sense></entryFree>
<entryFree id="x16" key="a"><gen>o(</gen><sense><tr>x</tr></sense></entryFree><entryFree id="n17" type="gloss" key="a)bc"><gen>o(</gen><sense><tr>x</tr></sense></entryFree></d>""" % ("three " * 60)


def test_dictionary(spark, tmp_path):
    from lexiloom.sources import dictionary

    (tmp_path / "d.xml").write_text(ENTRIES)
    got = {r["id"][-2:]: r for r in dictionary.entries(X.files(spark, str(tmp_path)), numerals=["trei=s"], common=[]).collect()}
    want = {"07": ("λόγος", "noun", "masculine"), "09": ("καλός", "adjective", "common"), "10": ("λύω", "verb", None), "11": ("καλῶς", "adverb", None), "13": ("εἰ", "conjunction", None), "14": ("ὅς", "pronoun", "common"), "15": ("τρεῖς", "numeral", "common")}
    assert {k: (r["headword"], r["pos"], r["gender"]) for k, r in got.items()} == want
    assert got["07"]["gloss"] == "word, reason" and got["07"]["id"] == "LSJ-000007" and got["07"]["ipa"] == "lóɡos"
    assert len(got["15"]["gloss"]) <= 200 and got["15"]["gloss"].endswith("...")


def test_documents(spark, tmp_path):
    lex = tmp_path / "lex.json"
    lex.write_text(json.dumps({"schema_version": "2.0.0", "lemmas": [{"id": "LSJ-00001", "headword": "λόγος", "ipa": "loɡos"}]}))
    assert [r["headword"] for r in D.lexicon(spark, str(lex)).collect()] == ["λόγος"]
    nested = {"_meta": {"a": {"x": 1}}, "vowels": {"a": {"a": 0, "e": 0.5}, "a_e": {"x": 1}}, "dialect_pairs": {"b": {"c": 1}}, "e": {"a": 0.5}, "t": {"u": "no"}}
    assert D.flatten_matrix(nested) == {"a": {"a": 0.0, "e": 0.5}, "e": {"a": 0.5}}
    (tmp_path / "r.jsonl").write_text('{"original":"a","pair_index":1}\n{"original":"b"}\n')
    (tmp_path / "r.json").write_text('[{"original":"a"},\n {"original":"b"}]')
    assert D.records(spark, str(tmp_path / "r.jsonl")).count() == D.records(spark, str(tmp_path / "r.json")).count() == 2
    (tmp_path / "q.txt").write_text("# c\n\n a b \nx\n")
    assert [r[0] for r in D.query_lines(spark, str(tmp_path / "q.txt")).collect()] == ["a b", "x"]
    (tmp_path / "f.json").write_text('{"a": 3, "b": 1}')
    assert {r["key"]: r["count"] for r in D.key_value_counts(spark, str(tmp_path / "f.json")).collect()} == {"a": 3, "b": 1}


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    folder = tmp_path / "rules"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.yaml").write_text('meta:\n  version: "1.10.0"\nrules:\n- {id: B-1, input: a, output: e}\n')
    (folder / "a.yml").write_text("version: 1.9.0\nrules:\n- {id: A-1, input: s, output: t, dialects: [x]}\n")
    (folder / "sub" / "c.yaml").write_text("rules: 3\n")
    got = D.rules(folder)
    assert [r["id"] for r in got] == ["A-1", "B-1"] and D.rules_table(spark, got).count() == 2
    assert D.rule_versions(folder) == {"a.yml": "1.9.0", "b.yaml": "1.10.0"} and D.latest_version(D.rule_versions(folder)) == "1.10.0"
    (folder / "d.yaml").write_text("rules:\n- {id: B-1}\n")
    with pytest.raises(ValueError):
        D.rules(folder)
    src = tmp_path / "s.yaml"
    src.write_text("_meta: {status: x}\nentries:\n  L1:\n  - {source_id: a, citation_ready: true}\n")
    assert D.source_references(spark, src).first()["refs"][0]["citation_ready"] is True
    src.write_text("entries:\n  L1:\n  - {source_id: a, quote: words}\n")
    with pytest.raises(ValueError):
        D.source_references(spark, src)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f1", None), ("f2", "5")], "source_file string, tm_id string")
    seen_df, seen = sinks.with_run_summary(df, "t1")
    sinks.write_json_lines(seen_df, str(tmp_path / "o"))
    assert seen.get == {"pairs": 2, "missing_tm": 1}
    assert [r[0] for r in sinks.pending(df, spark.read.json(str(tmp_path / "o")).where("tm_id is not null")).select("source_file").collect()] == ["f1"]
    f = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "source_file string, content binary")
    one = sinks.fingerprint(f).first()["fingerprint"]
    assert one == sinks.fingerprint(f.orderBy("content", ascending=False).repartition(3)).first()["fingerprint"] != sinks.fingerprint(f.limit(1)).first()["fingerprint"]
    doc = json.loads(sinks.matrix_document(spark.createDataFrame([("a", "b", 1.5)], "a string, b string, score double"), {"source": "x"}))
    assert doc["scores"] == {"a": {"b": 1.5}, "b": {"a": 1.5}} and doc["_meta"]["source"] == "x"
    mixed = spark.createDataFrame([("noun", "attic"), ("verb", "doric")], "pos string, dialect string")
    with pytest.raises(Exception):
        sinks.lexicon_summary(mixed).collect()


@pytest.mark.parametrize("block", [2, 100_000])
def test_sentences_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "LINE_BLOCK", block)
    values = ["a", "<s>", "b", "", None, "c", "<s>", "<s>", "d"]
    lines = spark.createDataFrame([(f, i, v) for f in "xy" for i, v in enumerate(values)], "file string, n int, value string").repartition(3)
    got = sorted((r["file"], r["sentence"], list(r["tokens"])) for r in D.sentences_from_lines(lines, "^<s>", "^([a-z])$").collect())
    assert got == [(f, k, t) for f in "xy" for k, t in ((0, ["a"]), (1, ["b", "c"]), (3, ["d"]))]


def test_flagged_pairs(spark, tmp_path):
    (tmp_path / "7.xml").write_text(
        "<TEI><choice><reg>λόγος</reg><orig>λώ<supplied>γ</supplied>ος</orig></choice><choice><sic>α</sic><corr>ε</corr></choice>"
        "<choice><orig>a b</orig><reg>ab</reg></choice><choice><orig>ὁ</orig><reg>ὁ</reg></choice></TEI>"
    )
    pairs = X.flagged_pairs(X.files(spark, str(tmp_path)))
    got = {r["form"]: list(r["reasons"]) for r in X.pair_drop_reasons(pairs).collect()}
    assert got == {"λώγος": ["uncertain"], "α": ["correction"], "a b": ["not_one_word", "not_greek"], "ὁ": ["same"]}
    kept = X.pair_drop_reasons(pairs, include_corrections=True, strict=False).where("size(reasons) = 0")
    assert sorted(r["form"] for r in kept.collect()) == ["α", "λώγος"]
