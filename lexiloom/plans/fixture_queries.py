"""Queries of operators SQL cannot restate, over small inputs given here, with the rows they must give.

Sources, sinks, script conversion, alignment kernels, the rule engine, validation and
resampling are run as they are; ``ORACLE_SQL`` lists the expected rows, worked out by
hand from the operators' definitions.  All values are compared as texts.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import profiles
from lexiloom.functions import scalars as S
from lexiloom.functions import unicode as U
from lexiloom.operators import align, catalogue, evaluation, labels, ladder, learn, notes, rules, validation
from lexiloom.plans import search as P
from lexiloom.session import shared_dir
from lexiloom.sources import dictionary, documents, sinks, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def case(name: str, columns: str, rows: list[tuple]):
    """Register a query whose result must be ``rows``."""
    names = columns.split()

    def literal(v: object) -> str:
        return "null" if v is None else "'" + str(v).replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    ORACLE_SQL[name] = "select " + ", ".join(f'"{c}"::varchar as "{c}"' for c in names) + f" from (values {values}) t(" + ", ".join(f'"{c}"' for c in names) + ")"

    def register(build):
        @functools.wraps(build)
        def query(spark: SparkSession, d: str) -> DataFrame:
            df = build(spark)
            text = lambda f: F.array_join(f.name, " ", "-") if f.dataType.simpleString().startswith("array<string") else F.to_json(f.name) if f.dataType.simpleString()[:5] in ("array", "struc", "map<s") else F.col(f.name).cast("string")
            return df.select(*[text(df.schema[c]).alias(c) for c in names])

        QUERIES[name] = query
        return query

    return register


def _words(spark: SparkSession, *words: str | None) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "w string")


def _put(spark: SparkSession, folder: str, files: dict[str, str]) -> str:
    """Small files in the shared folder, through Hadoop's file system; gives their folder."""
    root = f"{shared_dir(spark)}/fixtures-{spark.sparkContext.applicationId}/{folder}"
    jvm = spark._jvm
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
    return root


def _local(path: str) -> str:
    """A path for readers on the driver; documents they read lie in a folder it can see."""
    return path.removeprefix("file://").removeprefix("file:")


# --- text and phone scalars -------------------------------------------------------


@case("greek_marks", "w nfc pitch bare", [("ᾠδή", "ᾠδή", "ᾠδη", "ωδη"), ("ἄϋλος", "ἄϋλος", "ἀϋλος", "αυλος"), ("ό", "ό", "ο", "ο"), ("", "", "", ""), (None, None, None, None)])
def greek_marks(spark):
    return _words(spark, "ᾠδή", "ἄϋλος", "ό", "", None).select("w", U.nfc("w").alias("nfc"), U.strip_pitch_marks("w").alias("pitch"), U.strip_marks("w").alias("bare")).withColumn("w", U.nfc("w"))


@case("greek_phones", "w phones koine", [
    ("λόγος", "lóɡos", "lóɣos"), ("ἄνθρωπος", "ántʰrɔːpos", "ánθrɔːpos"), ("ᾠδή", "ɔːidɛ́ː", "ɔːiðɛ́ː"), ("αὐτός", "autós", "autós"), ("εὑρίσκω", "eurískɔː", "eurískɔː"),
    ("Αἵμων", "ahímɔːn", "ahímɔːn"), ("ἄϋπνος", "áypnos", "áypnos"), ("γῆ", "ɡɛ́ː", "ɡɛ́ː"), ("", "", ""), ("x1", "", ""), (None, None, None),
])
def greek_phones(spark):
    w = _words(spark, "λόγος", "ἄνθρωπος", "ᾠδή", "αὐτός", "εὑρίσκω", "Αἵμων", "ἄϋπνος", "γῆ", "", "x1", None)
    return w.select("w", S.to_ipa("w").alias("phones"), S.to_ipa("w", "koine").alias("koine"))


@case("phone_tokens", "w tokens bare_tokens", [("tʰá las.X", "tʰ a l a s . X", "t ʰ á l a s . X"), ("pʰɛ́ːn", "pʰ ɛː n", "p ʰ ɛ́ ː n"), ("", "", ""), (None, None, None)])
def phone_tokens(spark):
    return _words(spark, "tʰá las.X", "pʰɛ́ːn", "", None).select("w", S.tokenize("w").alias("tokens"), S.tokenize("w", [], marks=False).alias("bare_tokens"))


@case("consonant_shifts", "w shifted", [("a s s s a", "a t t s a"), ("s s", "t t"), ("a s a", "a s a")])
def consonant_shifts(spark):
    return _words(spark, "a s s s a", "s s", "a s a").select("w", S.shift_ss(F.split("w", " ")).alias("shifted"))


@case("entry_kmers", "w kmers unigrams", [("p a t e s s", "p t|t s|s s|t t", "p|t|s"), ("a e", "", ""), ("p", "", "p")])
def entry_kmers(spark):
    t = F.split("w", " ")
    joined = lambda k: F.array_join(S.entry_kmers(t, k, ["a", "e"], (S.shift_ss,)), "|")
    return _words(spark, "p a t e s s", "a e", "p").select("w", joined(2).alias("kmers"), joined(1).alias("unigrams"))


@case("transliteration", "w latin", [("ἄγγελος", "angelos"), ("ῥήτωρ", "rhētōr"), ("υἱός", "hyios"), ("ἄϋλος", "aylos"), ("ὁ ᾍδης", "ho haidēs"), ("", ""), (None, None)])
def transliteration(spark):
    return _words(spark, "ἄγγελος", "ῥήτωρ", "υἱός", "ἄϋλος", "ὁ ᾍδης", "", None).select("w", S.transliterate("w").alias("latin"))


@case("beta_code", "w greek", [("a)/nqrwpos", "ἄνθρωπος"), ("*)aqh=nai", "Ἀθῆναι"), ("lo/gos, so/s", "λόγος, σός"), ("", "")])
def beta_code(spark):
    return _words(spark, "a)/nqrwpos", "*)aqh=nai", "lo/gos, so/s", "").select("w", S.beta_to_unicode("w").alias("greek"))


@case("spelling_keys", "w base_key collapse_key", [("ῬΉΤΩΡ", "ρητωρ", "RITOR"), ("ϲοφόϲ", "σοφος", "SOPOS"), ("συνκαίω", "συνκαιω", "SINKEO"), ("ἄλλος", "αλλος", "ALOS"), ("ἄλος", "αλος", "ALOS"), ("Ξένη", "ξενη", "KSENI")])
def spelling_keys(spark):
    return _words(spark, "ῬΉΤΩΡ", "ϲοφόϲ", "συνκαίω", "ἄλλος", "ἄλος", "Ξένη").select("w", S.base_key("w").alias("base_key"), S.collapse_key("w").alias("collapse_key"))


@case("query_variants", "w variants", [("λόγον", "LOKO LOKON"), ("λόγος", "LOKO LOKOS"), ("γνῶσι", "KINOSI KINOSIN NOSI NOSIN")])
def query_variants(spark):
    return _words(spark, "λόγον", "λόγος", "γνῶσι").select("w", S.query_variants("w").alias("variants"))


@case("ipa_lookup_keys", "w key", [(" lóɡos ", "loɡos"), ("ɛ́ː", "ɛː"), ("", ""), (None, None)])
def ipa_lookup_keys(spark):
    return _words(spark, " lóɡos ", "ɛ́ː", "", None).select("w", S.ipa_key("w").alias("key"))


@case("sections", "w key cited", [("4.10", "4.1", ""), ("007", "7", ""), ("5a", "5a", ""), ("Buck § 10.1; § 12-14, §20", "Buck § 10.1; § 12-14, §20", "10.1 20")])
def sections(spark):
    return _words(spark, "4.10", "007", "5a", "Buck § 10.1; § 12-14, §20").select("w", S.section_key("w").alias("key"), S.cited_sections("w").alias("cited"))


@case("centuries", "a b centuries", [(-50, 120, "[-1,1,2]"), (1, 100, "[1]"), (None, None, "[-3,-2,-1,1,2,3,4,5,6,7,8]"), (101, None, "[2]"), (-100, -101, "[-2,-1]")])
def centuries(spark):
    return spark.createDataFrame([(-50, 120), (1, 100), (None, None), (101, None), (-100, -101)], "a int, b int").select("a", "b", S.centuries("a", "b").alias("centuries"))


@case("markup_cleaning", "w cleaned residue class", [
    ("α❨στρα(τηγῷ)❩", "αστρατηγῷ", "", "abbrev"), ("|num:1|α", "α", "", "variant"), ("κα̣ι", "και", "", "variant"), ("⎴ἔχοντες⎵", "ἔχοντες", "", "variant"), ("κυρίoυ", "κυρίου", "", "variant"),
    ("[λό]γ<ο>{ν}", "λόγον", "", "variant"), ("λόγος", "λόγος", "", "clean"), ("δραχμ…x", "δραχμx", "x", "variant"), ("", "", "", "variant"), (None, None, None, None),
])
def markup_cleaning(spark):
    w = _words(spark, "α❨στρα(τηγῷ)❩", "|num:1|α", "κα̣ι", "⎴ἔχοντες⎵", "κυρίoυ", "[λό]γ<ο>{ν}", "λόγος", "δραχμ…x", "", None)
    return w.select("w", S.clean_markup("w").alias("cleaned"), S.residue(S.clean_markup("w")).alias("residue"), F.when(F.col("w").isNotNull(), S.markup_class("w", F.lit("λόγος"))).alias("class"))


@case("alternation_labels", "a b labels category", [
    ("λόγος", "λώγος", '["ο/ω quantity"]', "ο/ω quantity"), ("κρίνω", "κρείνω", '["insertion (ε)"]', "insertion (ε)"), ("ἐν", "ἐμ", '["nasal assimilation"]', "nasal assimilation"),
    ("τη", "τι", '["itacism η/ι/ει"]', "itacism η/ι/ει"), ("λόγος", "λογος", "[]", "accent/breathing only"), ("αβγδε", "α", '["deletion (long)"]', "deletion (long)"),
    ("λόγος", "ῥόγως", '["gemination","ο/ω quantity"]', "gemination + ο/ω quantity"), ("αξβξγξ", "εξζξθξ", '["gemination","gemination","gemination"]', "multiple alternations"),
])
def alternation_labels(spark):
    pairs = [("λόγος", "λώγος"), ("κρίνω", "κρείνω"), ("ἐν", "ἐμ"), ("τη", "τι"), ("λόγος", "λογος"), ("αβγδε", "α"), ("λόγος", "ῥόγως"), ("αξβξγξ", "εξζξθξ")]
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("l", labels.alternations(F.col("a"), F.col("b")))
    return got.select("a", "b", F.to_json("l").alias("labels"), labels.category(F.col("l")).alias("category"))


@case("category_counts", "category n failed capitalised", [("x", 3, 1, 2), ("y", 1, 0, 0)])
def category_counts(spark):
    rows = spark.createDataFrame([("x", True, "Αθῆναι"), ("x", None, "λόγος"), ("x", False, "Ζεύς"), ("y", False, None)], "category string, failed boolean, lemma string")
    return labels.category_counts(rows, "category", F.col("failed"), S.is_capitalised("lemma"))


@case("query_modes", "w mode text left right", [("abc", "Short-query", "abc", None, None), ("abcd", "Full-form", "abcd", None, None), ("ab-c", "Partial-form", "abc", "ab", "c"), ("a. b_c", "Short-query", "a. b_c", None, None), ("-ab", "Partial-form", "ab", "", "ab"), ("a*", "Partial-form", "a", "a", "")])
def query_modes(spark):
    p = S.wildcard_parts("w")
    return _words(spark, "abc", "abcd", "ab-c", "a. b_c", "-ab", "a*").select("w", S.query_mode("w").alias("mode"), S.search_text("w").alias("text"), p["left"].alias("left"), p["right"].alias("right"))


@case("wildcard_matches", "shape l r full frag overlap starts", [
    ("prefix", "p a t", "", "true", 1, 3, "0:3"), ("prefix", "p a x", "", "false", 1, 2, "0:2"), ("suffix", "", "o s", "true", 1, 2, ""), ("suffix", "", "x y", "false", 0, 0, ""),
    ("infix", "a t", "o s", "true", 2, 4, "1:2"), ("infix", "o s", "p a", "false", 0, 0, "5:2"), ("infix", "z z", "o s", "false", 1, 2, ""),
])
def wildcard_matches(spark):
    rows = [("prefix", "p a t", ""), ("prefix", "p a x", ""), ("suffix", "", "o s"), ("suffix", "", "x y"), ("infix", "a t", "o s"), ("infix", "o s", "p a"), ("infix", "z z", "o s")]
    side = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    t = F.split(F.lit("p a t e r o s"), " ")
    df = spark.createDataFrame(rows, "shape string, l string, r string").withColumn("m", S.wildcard_match(F.col("shape"), side("l"), side("r"), t))
    starts = F.transform(S.fragment_matches(side("l"), t), lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["overlap"].cast("string")))
    return df.select("shape", "l", "r", "m.full", "m.frag", "m.overlap", F.array_join(starts, " ").alias("starts"))


@case("phone_matching", "a b same", [("e", "e", "true"), ("a", "aː", "true"), ("aː", "a", "false"), ("e", "eː", "false"), ("a s", "aː s", "true"), ("a s", "aː", "false")])
def phone_matching(spark):
    rows = spark.createDataFrame([("e", "e"), ("a", "aː"), ("aː", "a"), ("e", "eː"), ("a s", "aː s"), ("a s", "aː")], "a string, b string")
    return rows.select("a", "b", S.token_sequences_match(F.split("a", " "), F.split("b", " ")).alias("same"))


# --- alignment --------------------------------------------------------------------


@case("edit_distances", "a b raw normalised with_matrix", [("p t e n", "p t o", 6.0, 0.5, 0.35), ("a b", "a b", 0.0, 0.0, 0.0), ("p", "x", 5.0, 1.0, 1.0), ("p t", "t", 5.0, 0.5, 0.5), ("e n", "o n", 1.0, 0.5, 0.2)])
def edit_distances(spark):
    rows = spark.createDataFrame([("p t e n", "p t o"), ("a b", "a b"), ("p", "x"), ("p t", "t"), ("e n", "o n")], "a string, b string")
    a, b = F.split("a", " "), F.split("b", " ")
    return rows.select(
        "a", "b", align.weighted_distance(a, b, {}, list("ptkneoab")).alias("raw"), align.normalised_distance(a, b, {}).alias("normalised"),
        F.round(align.normalised_distance(a, b, {"e": {"o": 0.4}}), 6).alias("with_matrix"),
    )


@case("phone_distances", "a b d", [("p", "p", 0.0), ("á", "a", 0.0), ("e", "o", 0.4), ("o", "e", 0.4), ("p", "t", 1.0), ("p", "x", 5.0)])
def phone_distances(spark):
    known = frozenset("pteo")
    rows = [(a, b, align.phone_distance(a, b, {"e": {"o": 0.4}}, known)) for a, b in (("p", "p"), ("á", "a"), ("e", "o"), ("o", "e"), ("p", "t"), ("p", "x"))]
    return spark.createDataFrame(rows, "a string, b string, d double")


def _columns(alignment: Column) -> Column:
    return F.array_join(F.transform(alignment, lambda c: F.concat(F.coalesce(c["q"], F.lit("-")), F.lit("/"), F.coalesce(c["l"], F.lit("-")))), " ")


@case("local_alignment", "q l score columns confidence", [
    ("p t e n", "p t o", 4.0, "p/p t/t e/o n/-", 0.5), ("p t e n", "p t e n", 8.0, "p/p t/t e/e n/n", 1.0), ("p t e n", "k t e n", 6.0, "p/k t/t e/e n/n", 0.75), ("p", "k", 0.0, "p/k", 0.0), ("", "a", 0.0, "", 0.0),
])
def local_alignment(spark):
    side = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = spark.createDataFrame([("p t e n", "p t o"), ("p t e n", "p t e n"), ("p t e n", "k t e n"), ("p", "k"), ("", "a")], "q string, l string")
    sw = rows.withColumn("sw", align.local_alignment_udf({}, list("ptkneo"))(side("q"), side("l")))
    return sw.select("q", "l", "sw.score", _columns(F.col("sw.alignment")).alias("columns"), align.confidence(F.col("sw.score"), side("q"), side("l")).alias("confidence"))


@case("global_alignment", "q l columns", [("a b c", "a b c", "a/a b/b c/c"), ("a b c", "a c", "a/a b/- c/c"), ("a b", "x y", "a/x b/y"), ("a", "", "a/-"), ("", "b", "-/b")])
def global_alignment(spark):
    side = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = spark.createDataFrame([("a b c", "a b c"), ("a b c", "a c"), ("a b", "x y"), ("a", ""), ("", "b")], "q string, l string")
    return rows.select("q", "l", _columns(align.global_alignment_udf()(side("q"), side("l"))).alias("columns"))


@case("closest_forms", "key form", [("λογος", "λόγος"), ("λογου", "λόγου"), ("λογο", "λόγος")])
def closest_forms(spark):
    rows = spark.createDataFrame([("λογος", ["λόγου", "λογος", "λόγος"]), ("λογου", ["λόγος", "λόγου"]), ("λογο", ["λόγος", "λόγου"])], "key string, forms array<string>")
    # the key and accent functions are given; here letters without marks, by translation
    plain = lambda f: F.translate(f, "ό", "ο")
    return rows.select("key", align.closest_form(F.col("forms"), F.col("key"), plain, lambda f: F.length(F.regexp_replace(f, "[^ό]", ""))).alias("form"))


@case("aligned_pair_counts", "a b n", [("a", "a", 3), ("a", "b", 2), ("b", None, 1), ("c", None, 1)])
def aligned_pair_counts(spark):
    al = "array<struct<q:string,l:string>>"
    rows = [([("a", "a"), ("a", "b"), ("b", None)], 1), ([("b", "a"), (None, "c")], 1), ([("a", "a")], 2)]
    return learn.column_counts(spark.createDataFrame(rows, f"alignment {al}, w long"), F.col("w"))


@case("log_odds_by_smoothing", "smoothing a b n score", [
    ("laplace", "a", "a", 1, -0.415037), ("laplace", "a", "b", 2, 0.169925), ("laplace", "b", "b", 0, 0.584963),
    ("floor", "a", "a", 1, -0.415037), ("floor", "a", "b", 2, 0.584963), ("floor", "b", "b", 0, -10.0),
])
def log_odds_by_smoothing(spark):
    counts = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("b", None, 4)], "a string, b string, n long")
    parts = [learn.log_odds(counts, how).select(F.lit(how).alias("smoothing"), "a", "b", "n", F.round("score", 6).alias("score")) for how in ("laplace", "floor")]
    return parts[0].unionByName(parts[1])


@case("pair_counters", "fate n", [("seen", 3), ("skipped_empty", 2), ("skipped_long", 1)])
def pair_counters(spark):
    rows = spark.createDataFrame([(["a"], ["b"], 3), ([], ["b"], 1), (["a"], None, 1), (["a"] * 201, ["b"], 1)], "q array<string>, l array<string>, w int")
    return learn.pair_counters(rows, "q", "l", F.col("w"))


@case("matrix_checks", "p1 p2 reason", [("a", "b", "asymmetric"), ("b", "a", "asymmetric"), ("b", "b", "diagonal"), ("a", "c", "missing"), ("c", "a", "missing"), ("d", "e", "bounds"), ("e", "d", "bounds")])
def matrix_checks(spark):
    rows = [("a", "a", 0.0), ("a", "b", 0.5), ("b", "a", 0.4), ("b", "b", 0.1), ("a", "c", 0.2), ("d", "d", 0.0), ("d", "e", 1.5), ("e", "d", 1.5)]
    return learn.matrix_violations(spark.createDataFrame(rows, "p1 string, p2 string, d double"))


@case("matrix_generation", "p1 p2 d", [
    ("p", "p", 0.0), ("p", "b", 0.2), ("p", "f", 0.1), ("b", "p", 0.2), ("b", "b", 0.0), ("b", "f", 0.2), ("f", "p", 0.1), ("f", "b", 0.2), ("f", "f", 0.0),
])
def matrix_generation(spark):
    return documents.matrix_table(spark, validation.complete_matrix({"p": {"b": 0.2}, "b": {}}, {"f": ("p", 0.1)}))


# --- rules ------------------------------------------------------------------------

# Own rules, each with an alignment (query over lemma) it decides.
_RULE_CASES = [
    ("observed", "p t - e", "k t n -", [], "OBS-SUB@0 OBS-DEL@2 OBS-INS@3"),
    ("longer first", "p p", "k t", [{"id": "A", "input": "k", "output": "p"}, {"id": "B", "input": "kt", "output": "pp"}], "B@0"),
    ("context first", "a p a", "a k a", [{"id": "A", "input": "k", "output": "p"}, {"id": "C", "input": "k", "output": "p", "context": "V_V"}], "C@1"),
    ("final", "a t", "a s", [{"id": "R", "input": "s", "output": "t", "context": "_#"}], "R@1"),
    ("not final", "t a", "s a", [{"id": "R", "input": "s", "output": "t", "context": "_#"}], "OBS-SUB@0"),
    ("initial", "t a", "s a", [{"id": "R", "input": "s", "output": "t", "context": "#_V"}], "R@0"),
    ("before nasal", "t m k", "s m k", [{"id": "R", "input": "s", "output": "t", "context": "_NC"}], "R@0"),
    ("after e", "e t", "e s", [{"id": "R", "input": "s", "output": "t", "context": "after e, i, or r"}], "R@1"),
    ("elsewhere", "a t", "a s", [{"id": "R", "input": "s", "output": "t", "context": "all environments except after e, i, or r"}], "R@1"),
    ("set", "t k", "s k", [{"id": "R", "input": "s", "output": "t", "context": "_{k,p}"}], "R@0"),
    ("tail", "t a k p", "s a k p", [{"id": "R", "input": "s", "output": "t", "context": "_...kp"}], "R@0"),
    ("unknown context", "t", "s", [{"id": "R", "input": "s", "output": "t", "context": "nonsense"}], "OBS-SUB@0"),
    ("insertion", "a i a", "a - a", [{"id": "I", "input": "", "output": "i", "is_insertion": True}], "I@1"),
    ("no insertion rule", "a i a", "a - a", [{"id": "I", "input": "", "output": "i"}], "OBS-INS@1"),
    ("deletion", "a -", "a n", [{"id": "D", "input": "n", "output": "", "context": "_#"}], "D@1"),
    ("unmarked length", "e", "a", [{"id": "L", "input": "aː", "output": "e"}], "L@0"),
    ("marked length", "e", "aː", [{"id": "L", "input": "a", "output": "e"}], "OBS-SUB@0"),
    ("suffix before the run", "l o n", "l o s", [{"id": "S", "input": "os", "output": "on", "context": "_#"}], "S@1"),
    ("strict first", "e t", "a s", [{"id": "LONG", "input": "aːs", "output": "et"}, {"id": "SHORT", "input": "a", "output": "e"}], "SHORT@0 OBS-SUB@1"),
    ("constraint met", "t", "s", [{"id": "K", "input": "s", "output": "t", "lemma_constraints": {"pos": ["noun"]}}], "K@0"),
    ("constraint not met", "t", "s", [{"id": "K", "input": "s", "output": "t", "lemma_constraints": {"pos": ["verb"]}}], "OBS-SUB@0"),
]


@case("rule_matching", "case applications", [(name, want) for name, _, _, _, want in _RULE_CASES])
def rule_matching(spark):
    out = None
    for name, q, l, raw, _ in _RULE_CASES:  # noqa: E741
        cols = [{"q": None if a == "-" else a, "l": None if b == "-" else b} for a, b in zip(q.split(), l.split(), strict=True)]
        df = spark.createDataFrame([(name, cols, {"pos": "noun"})], f"case string, alignment {align.ALIGNMENT}, lemma struct<pos:string>")
        got = df.select("case", rules.explain_udf(rules.compile_rules(raw))("alignment", F.col("lemma")).alias("a"))
        got = got.select("case", F.array_join(F.transform("a", lambda x: F.concat(x["rule_id"], F.lit("@"), x["position"].cast("string"))), " ").alias("applications"))
        out = got if out is None else out.unionByName(got)
    return out


@case("rule_order", "place id", [(0, "N2"), (1, "N1"), (2, "LONG"), (3, "A"), (4, "B")])
def rule_order(spark):
    raw = [{"id": "A", "input": "k", "output": "p"}, {"id": "B", "input": "t", "output": "p"}, {"id": "LONG", "input": "kt", "output": "pp"}, {"id": "N1", "input": "k", "output": "p", "context": "V_V"}, {"id": "NONE"}, {"id": "N2", "input": "kt", "output": "p", "context": "_#"}]
    return spark.createDataFrame([(i, r.id) for i, r in enumerate(rules.compile_rules(raw).rules)], "place int, id string")


@case("rules_by_id", "source target steps prose", [
    ("a", "b", '[{"_at":0,"rule_id":"R2","input":"x","output":"","position":-1},{"_at":1,"rule_id":"R1","input":"a","output":"b","position":-1}]', "/a/ becomes /b/ by R2 /x/ to //; R1 /a/ to /b/ (distance 0.250)."),
    ("a", "c", "[]", "/a/ and /c/ differ by 0.500; no rule applies."),
])
def rules_by_id(spark):
    pairs = spark.createDataFrame([("a", "b", ["R2", "R1"], 0.25), ("a", "c", ["gone"], 0.5)], "source string, target string, rule_ids array<string>, distance double")
    named = spark.createDataFrame([("R1", "a", "b"), ("R2", "x", None)], "id string, input string, output string")
    return notes.explained_by_ids(pairs, named)


# --- search -----------------------------------------------------------------------

_TOY = profiles.LanguageProfile("toy", lambda c, d: c, tuple("ptkneo"), tuple("eo"))
_TOY_ROWS = [("L1", "pten", "pten", "a"), ("L2", "pto", "pto", " "), ("L3", "kten", "kten", "b"), ("L4", None, "x", "b"), (None, "oo", "oo", None)]
_TOY_QUERIES = [(1, "pten"), (2, "pte"), (3, "pt-n"), (4, "oo"), (5, "kt-"), (7, "-en")]


def _toy(spark: SparkSession) -> DataFrame:
    return P.prepare_lexicon(spark.createDataFrame(_TOY_ROWS, "id string, headword string, ipa string, dialect string"), _TOY)


@case("search_index", "kmer id", [("p t", "L1"), ("p t", "L2"), ("t n", "L1"), ("t n", "L3"), ("k t", "L3")])
def search_index(spark):
    return P.postings(_toy(spark))


@case("search_paths", "qid path", [(1, "seeded"), (3, "seeded_partial"), (8, "unigram"), (9, "proximity"), (10, "unigram_partial"), (11, "proximity_partial")])
def search_paths(spark):
    q = spark.createDataFrame([(1, "pten"), (3, "pt-n"), (8, "k"), (9, "e"), (10, "e-k"), (11, "o-")], "qid int, query string")
    return P.candidates(P.prepare_queries(q, _TOY), _toy(spark)).select("qid", "path").distinct()


@case("search_results", "qid mode rank id confidence match_type uncertainty bucket", [
    (1, "Full-form", 1, "L1", 1.0, "Exact", "Low", "Supported"), (1, "Full-form", 2, "L3", 0.75, "Rule-based", "Medium", "Supported"), (1, "Full-form", 3, "L2", 0.5, "Low-confidence", "High", "Exploratory"),
])
def search_results(spark):
    ruleset = rules.compile_rules([{"id": "AAA-001", "input": "k", "output": "p", "dialects": ["x"], "name_en": "k to p"}], list("ptkneo"))
    return P.search(spark.createDataFrame(_TOY_QUERIES[:1], "qid int, query string"), _toy(spark), _TOY, ruleset)


@case("search_best", "qid mode id", [(1, "Full-form", "L1"), (2, "Short-query", "L1"), (3, "Partial-form", "L1"), (4, "Short-query", "oo"), (5, "Partial-form", "L3"), (7, "Partial-form", "L3")])
def search_best(spark):
    return P.search(spark.createDataFrame(_TOY_QUERIES, "qid int, query string"), _toy(spark), _TOY, results=1)


@case("search_drawings", "id drawing dialect_attribution", [
    ("L1", "query: p t e n\n       | | | |\nlemma: p t e n", "lemma dialect: a"), ("L3", "query: p t e n\n       : | | |\nlemma: k t e n", "lemma dialect: b; query-compatible dialects: x"),
    ("L2", "query: p t e n\n       | | .\nlemma: p t o -", "lemma dialect: unknown"),
])
def search_drawings(spark):
    ruleset = rules.compile_rules([{"id": "AAA-001", "input": "k", "output": "p", "dialects": ["x"], "name_en": "k to p"}], list("ptkneo"))
    return P.search(spark.createDataFrame(_TOY_QUERIES[:1], "qid int, query string"), _toy(spark), _TOY, ruleset)


@case("near_length_turns", "turn id", [(1, "x1"), (2, "x3"), (3, "x0"), (4, "x2"), (5, "x5")])
def near_length_turns(spark):
    return P.near_length(spark.createDataFrame([(1, f"x{i}", d, i) for i, d in enumerate([2, 0, 0, 1, 3, 1])], "qid int, id string, delta int, seed_pos int"))


@case("merged_candidates", "id pos", [("b", 1), ("a", 2), ("c", 3)])
def merged_candidates(spark):
    cands = lambda *ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "qid int, id string, pos int")
    return P.merge_candidates(cands("b", "a"), cands("a", "c", "b"))


@case("engine_run", "headword match_type bucket summary kinds cites meta_ruleset_version", [("λόγος", "Rule-based", "Supported", "1 named changes", "orthographic_correspondence", "Short", "1.0.0")])
def engine_run(spark):
    from lexiloom.facade import Engine, Request

    lex = spark.createDataFrame([("LSJ-00001", "λόγος", "lóɡos", "attic"), ("LSJ-00002", "λόφος", "lópʰos", "attic")], "id string, headword string, ipa string, dialect string")
    entries = spark.createDataFrame([("λώγος", "λόγος", ["λόγος"], "orthographic_correspondence", ["late_spelling"], "high")], "original string, normalized string, candidate_headwords array<string>, kind string, tags array<string>, confidence string")
    refs = spark.createDataFrame([("LSJ-00001", [("s1", "Short")])], "entry_id string, refs array<struct<source_id:string,short_citation:string>>")
    got = Engine(spark, lex, raw_rules=[{"id": "VOW-001", "name_en": "o lengthened", "input": "o", "output": "ɔː"}], rule_version="1.0.0", entries=entries, sources=refs).run(Request("λώγος", max_candidates=1))
    return got.select("headword", "match_type", "bucket", "summary", F.array_join("notes.kind", ",").alias("kinds"), F.array_join("source_refs.short_citation", ",").alias("cites"), "meta_ruleset_version")


@case("request_limits", "request ok", [("plain", "true"), ("blank", "false"), ("long", "false"), ("none", "false"), ("dialect", "false"), ("language", "false")])
def request_limits(spark):
    from lexiloom.facade import Request

    def ok(**given) -> bool:
        try:
            Request(**given)
        except ValueError:
            return False
        return True

    given = {"plain": {"query": " λόγος "}, "blank": {"query": " "}, "long": {"query": "x" * 65}, "none": {"query": "x", "max_candidates": 0}, "dialect": {"query": "x", "dialect": "doric"}, "language": {"query": "x", "language": "none"}}
    return spark.createDataFrame([(k, ok(**v)) for k, v in given.items()], "request string, ok boolean")


# --- ladder and evaluation --------------------------------------------------------


@case("lemma_candidates", "query lemma source_key cost place", [("q", "lego", "legei", 0.0, 0), ("q", "logos", "logo", 1.0, 1), ("q", "alien", "logo", 1.0, 2)])
def lemma_candidates(spark):
    cands = spark.createDataFrame([("q", "legei", 0.0, 5), ("q", "logo", 1.0, 9), ("q", "logu", 2.0, 1)], "query string, word string, cost double, freq long")
    forms = [("légei", "legei", "lego", "grc", 7), ("lógo", "logo", "logos", "grc", 4), ("lógo", "logo", "alien", "all", 90), ("lógu", "logu", "logos", "grc", 4), ("lógo", "logo", "lego", "grc", 7)]
    return ladder.lemma_candidates(cands, spark.createDataFrame(forms, "form string, key string, lemma string, lang string, lemma_freq long"))


@case("rerankers", "name order", [("R0", "c a b"), ("R2", "c b a"), ("R3", "c a b"), ("R5", "c b a")])
def rerankers(spark):
    rows = [("a", 0.5, 50, 1, 0.0, 0.0, 6.0), ("b", 1.0, 50, 1, 1.0, 0.0, 0.0), ("c", 0.0, 60, 1, 0.0, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "word string, cost double, form_freq long, lemma_freq long, century double, dialect double, penalty double")
    out = None
    from pyspark.sql import Window

    for name in ("R0", "R2", "R3", "R5"):
        keys = ladder.rerank_order(name, *[F.col(c) for c in ("cost", "form_freq", "lemma_freq", "century", "dialect")], F.lit(0.0), F.col("penalty"))
        got = df.withColumn("r", F.row_number().over(Window.orderBy(*keys, "word"))).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("order"))
        got = got.select(F.lit(name).alias("name"), "order")
        out = got if out is None else out.unionByName(got)
    return out


@case("gold_ranks", "t lenient strict n_cand", [(1, 0, 1, 3), (2, None, None, 1), (3, None, None, 0)])
def gold_ranks(spark):
    cands = spark.createDataFrame([(1, "λογος", 0), (1, "λόγος", 1), (1, "x", 2), (2, "y", 0)], "t int, lemma string, place int")
    return evaluation.gold_ranks(cands, spark.createDataFrame([(1, "λόγος"), (2, "z"), (3, "z")], "t int, gold string"), ["t"])


@case("merged_slices", "doc n", [("a", 1), ("b", 2), ("c", 1)])
def merged_slices(spark):
    part = lambda *rows: spark.createDataFrame(rows, "doc string, wid int, stage string")
    got = evaluation.merged_slices([part(("a", 1, "s"), ("b", 1, "s")), part(("b", 2, "s"), ("c", 1, "s"))], ["doc", "wid"], ["stage"])
    return got.groupBy("doc").agg(F.count("*").alias("n"))


@case("overlap_roles", "tm role", [("5", "dev"), ("7", "unused")])
def overlap_roles(spark):
    left = spark.createDataFrame([(" 5",), ("6",), ("7",), (None,), ("",)], "tm string")
    return evaluation.overlap_roles(left, spark.createDataFrame([("5", "dev"), ("7 ", "unused"), ("8", "test"), ("", "x")], "tm string, role string"), "tm", "role")


@case("posting_lists", "key items n", [("1", "a b", 2), ("2", "c", 1)])
def posting_lists(spark):
    rows = spark.createDataFrame([("b", "1", 2), ("a", "1", 1), ("c", "2", 3), ("d", None, 4)], "id string, section string, at int")
    return catalogue.posting_lists(rows, F.col("section"), "id", ["at"])


@case("catalogue_order", "what place id", [("rules", 1, "a"), ("rules", 2, "c"), ("glossary", 1, "alpha/d1/"), ("glossary", 2, "alpha/d1/r"), ("glossary", 3, "beta/d0/")])
def catalogue_order(spark):
    r = spark.createDataFrame([("c", "1", "x", ["d1"]), ("a", "1", "x", ["d1", "d2"]), ("b", "2", "x", None)], "id string, buck_section string, category string, affected_dialects array<string>")
    g = spark.createDataFrame([("beta", "d0", None), ("alpha", "d1", "r"), ("alpha", "d1", None)], "word string, dialect string, rule_id string")
    got = catalogue.find_rules(r, section="1", dialect="d1").select(F.lit("rules").alias("what"), "place", "id")
    return got.unionByName(catalogue.find_glossary(g).select(F.lit("glossary").alias("what"), "place", F.concat_ws("/", "word", "dialect", F.coalesce("rule_id", F.lit(""))).alias("id")))


@case("mcnemar_values", "only_a only_b p", [(1, 9, 0.021484), (0, 0, 1.0), (5, 5, 1.0), (0, 6, 0.03125)])
def mcnemar_values(spark):
    rows = spark.createDataFrame([(1, 9), (0, 0), (5, 5), (0, 6)], "only_a long, only_b long")
    return rows.select("only_a", "only_b", F.round(evaluation.mcnemar_p("only_a", "only_b"), 6).alias("p"))


@case("bootstrap_of_equals", "a b diff a_low a_high diff_low diff_high", [(0.5, 0.5, 0.0, 0.5, 0.5, 0.0, 0.0)])
def bootstrap_of_equals(spark):
    """Documents that are all alike leave no spread."""
    rows = spark.createDataFrame([(f"d{i}", k == 0, k == 1) for i in range(40) for k in range(2)], "doc string, a boolean, b boolean")
    return evaluation.cluster_bootstrap(rows, "doc", "a", "b", resamples=50)


@case("hard_cases", "case_id all_matched matched missing outranking", [("c1", "true", "a:2 b:3", "", "x:1"), ("c2", "false", "", "z", "q:1")])
def hard_cases(spark):
    text = json.dumps({"cases": [{"case_id": "c1", "input_form": "i", "expected": [{"headword": "a", "acceptable": ["a2"]}, {"headword": "b"}]}, {"case_id": "c2", "input_form": "j", "expected": [{"headword": "z"}]}]})
    expected = documents.hard_cases(spark, _local(_put(spark, "cases", {"cases.json": text})) + "/cases.json")
    hits = spark.createDataFrame([("c1", 1, "x"), ("c1", 2, "a2"), ("c1", 3, "b"), ("c1", 4, "y"), ("c2", 1, "q")], "case_id string, rank int, headword string")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["headword"], F.lit(":"), x["rank"].cast("string"))), " ")
    got = evaluation.evaluate_cases(expected.select("case_id", "headword", "acceptable"), hits)
    return got.select("case_id", "all_matched", shown("matched").alias("matched"), "missing", shown("outranking").alias("outranking"))


@case("facets_and_ceilings", "what a b c", [("facets", 2, 3, 2), ("ceilings", 3, 2, 1), ("coverage", 2, 1, 0.5), ("budget", 10, 100, None), ("costs", 1, 10, 0.02)])
def facets_and_ceilings(spark):
    m = spark.createDataFrame([(1, True, None), (1, False, True), (2, True, False)], "t int, gold boolean, f boolean")
    facets = evaluation.measure_facets(m, [F.col("f")], ["t"], "gold").select(F.lit("facets").alias("what"), F.col("tokens").alias("a"), F.col("candidates").alias("b"), F.col("kept").cast("double").alias("c"))
    c = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    ceilings = evaluation.nested_ceilings(c, first=F.col("a"), second=F.col("b")).select(F.lit("ceilings").alias("what"), F.col("n").alias("a"), F.col("first").alias("b"), F.col("second").cast("double").alias("c"))
    w = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "word string")
    coverage = evaluation.vocabulary_coverage(w, spark.createDataFrame([("a",)], "word string")).select(F.lit("coverage").alias("what"), F.col("n_words").alias("a"), F.col("n_known").alias("b"), F.col("coverage").alias("c"))
    files = spark.createDataFrame([(f"f{i:03}", 10) for i in range(50)], "f string, n int")
    budget = evaluation.budget_prefix(files, "f", "n", 95).agg(F.count("*").alias("a"), F.sum("n").alias("b")).select(F.lit("budget").alias("what"), "a", "b", F.lit(None).cast("double").alias("c"))
    costs = evaluation.exclusion_costs(files, {"corpus": spark.createDataFrame([("f001",)], "f string")}, ["f"], "n").select(F.lit("costs").alias("what"), F.col("files").alias("a"), F.col("tokens").alias("b"), F.col("share").alias("c"))
    whole = facets.unionByName(ceilings).unionByName(coverage).unionByName(budget).unionByName(costs)
    return whole.withColumn("c", F.when(F.col("c") == F.floor("c"), F.col("c").cast("bigint").cast("string")).otherwise(F.col("c").cast("string")))


@case("positional_join", "at k left right", [(0, "x", "1", "3"), (1, "y", "2", "4")])
def positional_join(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "at int, k string, left int")
    return evaluation.positional_join(a, spark.createDataFrame([(1, "y", 4), (0, "x", 3)], "at int, k string, right int"), "at", ["k"]).withColumnRenamed("right_right", "right")


@case("zones", "cost zone naive", [(1.0, "confident", "confident"), (1.5, "explore", "explore")])
def zones(spark):
    return spark.createDataFrame([(1.0, True), (1.5, False)], "cost double, r boolean").select("cost", evaluation.zone(F.col("r")).alias("zone"), evaluation.zone_of_cost(F.col("cost")).alias("naive"))


@case("latency_changes", "metric regressed", [("mean", "true"), ("p95", "false"), ("max", "false")])
def latency_changes(spark):
    m = lambda **kv: spark.createDataFrame(list(kv.items()), "metric string, value double")
    return evaluation.latency_regressions(m(mean=1.2, p95=1.0, max=1.1), m(mean=1.0, p95=1.0, max=1.0))


@case("noisy_labels", "wrong_known flipped_share_ok same_again", [("true", "true", "true")])
def noisy_labels(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k")).withColumn("l", ladder.noisy_label(F.col("k"), F.lit("noun"), ["noun", "verb", "adverb"]))
    share = F.avg((F.col("l") != "noun").cast("int"))
    return df.withColumn("m", ladder.noisy_label(F.col("k"), F.lit("noun"), ["noun", "verb", "adverb"])).agg(
        F.bool_and(F.col("l").isin("noun", "verb", "adverb")).alias("wrong_known"), share.between(0.08, 0.12).alias("flipped_share_ok"), F.bool_and(F.col("l") == F.col("m")).alias("same_again")
    )


# --- sources ----------------------------------------------------------------------

_EPIDOC = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><idno type="other">9</idno><idno type="TM">{tm}</idno></teiHeader><text><body><ab>
<choice><reg>λόγ<hi>ος</hi></reg><orig>λώγος</orig></choice> word<lb n="1" break="no"/>part <gap/> after
<choice><orig>a</orig><orig>b</orig><reg>c</reg></choice><choice><orig> </orig><reg/></choice></ab></body></text></TEI>"""
_TORN = '<TEI xmlns="x"><teiHeader><idno type="TM">77</idno><text><body><p><choice><reg>νόμου</reg><orig>νομου</orig></choice></body></text></TEI>'
_EVIL = '<!DOCTYPE a [<!ENTITY b "c">]><a><choice><reg>&b;</reg><orig>x</orig></choice></a>'


def _epidoc(spark: SparkSession) -> DataFrame:
    folder = _put(spark, "epidoc", {"sub/60001.xml": _EPIDOC.format(tm="123"), "x60002y7.xml": _EPIDOC.format(tm=" "), "torn.xml": _TORN, "evil.xml": _EVIL})
    return xml.files(spark, folder)


@case("epidoc_choices", "tm_id original regularized pair_index", [("123", "λώγος", "λόγος", 0), ("60002", "λώγος", "λόγος", 0), ("77", "νομου", "νόμου", 0)])
def epidoc_choices(spark):
    return xml.choices(_epidoc(spark))


@case("epidoc_failures", "file", [("evil.xml",), ("torn.xml",)])
def epidoc_failures(spark):
    return xml.failures(_epidoc(spark)).select(F.regexp_extract("source_file", "([^/]+)$", 1).alias("file"))


@case("epidoc_running_text", "n text", [(0, "λόγος wordpart"), (1, "after c")])
def epidoc_running_text(spark):
    return xml.running_text(_epidoc(spark).where("source_file like '%60001.xml'"))


_TREEBANK = (
    '<treebank><document_meta name="doc1" date_not_before="100"/><sentence id="1">'
    '<word id="1" form_orig="λόγος" form_reg="λόγος" lemma_reg="λόγος|num:1|" postag_reg="n" lang="grc"/>'
    '<word id="2" form_orig="λώγος" form_reg="λόγος" lemma_reg="λόγος" lemma_orig="λόγος" postag_reg="n"/>'
    '<word id="3" form_orig="." form_reg="." lemma_reg="." postag_reg="u"/><word id="4" form_orig="[λο]" form_reg="λο" lemma_reg="λο" postag_reg="n"/>'
    '<word id="5" form_orig="verbum" form_reg="verbum" lemma_reg="verbum" postag_reg="n" lang="lat"/></sentence></treebank>'
)


@case("treebank_tokens", "doc wid lemma_gold stratum", [("doc1", "1", "λόγος", "clean"), ("doc1", "2", "λόγος", "variant_ortho")])
def treebank_tokens(spark):
    return xml.treebank(xml.files(spark, _put(spark, "treebank", {"t.xml": _TREEBANK})))


_FLAGGED = (
    "<TEI><choice><reg>λόγος</reg><orig>λώ<supplied>γ</supplied>ος</orig></choice><choice><sic>α</sic><corr>ε</corr></choice>"
    "<choice><orig>a b</orig><reg>ab</reg></choice><choice><orig>ὁ</orig><reg>ὁ</reg></choice></TEI>"
)


@case("flagged_pairs", "form flags reasons", [("λώγος", "supplied", "uncertain"), ("α", "corr", "correction"), ("a b", "", "not_one_word not_greek"), ("ὁ", "", "same")])
def flagged_pairs(spark):
    return xml.pair_drop_reasons(xml.flagged_pairs(xml.files(spark, _put(spark, "flagged", {"7.xml": _FLAGGED}))))


_ENTRIES = """<d>
<entryFree id="n7" key="lo/gos" type="main"><orth extent="full" lang="greek">lo/gos</orth>, <gen lang="greek">o(</gen>, <sense><tr>word</tr>, <tr>reason</tr></sense><sense><tr>other</tr></sense></entryFree>
<entryFree id="n7" key="a)/llo"><gen>o(</gen><sense><tr>again</tr></sense></entryFree>
<entryFree id="n9" key="kalo/s2"><orth lang="greek">kalo/s</orth>, <itype>h/</itype>, <itype>o/n</itype>, <sense><tr>fair</tr></sense></entryFree>
<entryFree id="n10" key="lu/w"><orth lang="greek">lu/w</orth><sense><tns>fut.</tns> <tr>loose</tr></sense></entryFree>
<entryFree id="n11" key="kalw=s"><orth lang="greek">kalw=s</orth><sense><tr>well</tr></sense></entryFree>
<entryFree id="n12" key="ai)/"><orth lang="greek">ai)/</orth>, Dor. Conj., <sense><tr>if</tr></sense></entryFree>
<entryFree id="n13" key="ei)"><orth lang="greek">ei)</orth>, <sense>Conj., <tr>if</tr></sense></entryFree>
<entryFree id="n15" key="trei=s"><orth lang="greek">trei=s</orth><sense><tr>three</tr></sense></entryFree></d>"""


@case("dictionary_entries", "id headword ipa pos gender gloss", [
    ("LSJ-000007", "λόγος", "lóɡos", "noun", "masculine", "word, reason"), ("LSJ-000009", "καλός", "kalós", "adjective", "common", "fair"), ("LSJ-000010", "λύω", "lýɔː", "verb", None, "loose"),
    ("LSJ-000011", "καλῶς", "kalɔ́ːs", "adverb", None, "well"), ("LSJ-000013", "εἰ", "eː", "conjunction", None, "if"), ("LSJ-000015", "τρεῖς", "tréːs", "numeral", "common", "three"),
])
def dictionary_entries(spark):
    return dictionary.entries(xml.files(spark, _put(spark, "dictionary", {"d.xml": _ENTRIES})), numerals=["trei=s"], common=[])


@case("lexicon_build", "built again entries dialect nouns rows", [("true", "false", 6, "attic", 1, 6)])
def lexicon_build(spark):
    src, out = _put(spark, "dictionary", {"d.xml": _ENTRIES}), _put(spark, "lexicon", {}) + "/doc"
    built = sinks.build_lexicon(spark, src, out, numerals=["trei=s"], common=[])
    again = sinks.build_lexicon(spark, src, out, skip_if_present=True)
    meta = json.loads(spark.read.text(f"{out}/_meta").first()[0])
    return spark.createDataFrame([(built, again, meta["entries"], meta["dialect"], meta["pos_counts"]["noun"], spark.read.json(f"{out}/lemmas").count())], "built boolean, again boolean, entries int, dialect string, nouns int, rows int")


_DOCS = {
    "lex.json": json.dumps({"schema_version": "2.0.0", "lemmas": [{"id": "LSJ-00001", "headword": "λόγος", "ipa": "loɡos"}]}),
    "r.jsonl": '{"original":"a","pair_index":1}\n{"original":"b"}\n', "r.json": '[{"original":"a"},\n {"original":"c","tm_id":"5"}]', "q.txt": "# c\n\n a b \nx\n", "f.json": '{"a": 3, "b": 1}',
    "m.json": json.dumps({"_meta": {"a": {"x": 1}}, "vowels": {"a": {"a": 0, "e": 0.5}, "a_e": {"x": 1}}, "dialect_pairs": {"b": {"c": 1}}, "e": {"a": 0.25}, "t": {"u": "no"}}),
    "s.yaml": "_meta: {status: x}\nentries:\n  L1:\n  - {source_id: a, short_citation: S, citation_ready: true}\n", "o.yaml": "entries:\n- {original: λώγος, normalized: λόγος, kind: beginner_aid, tags: [], reviewed_at: 2024-01-02}\n",
    "k.yaml": "nouns: [a, b]\nname: x\n", "rules/b.yaml": 'meta:\n  version: "1.10.0"\nrules:\n- {id: B-1, input: a, output: e}\n', "rules/a.yml": "version: 1.9.0\nrules:\n- {id: A-1, input: s, output: t, dialects: [x]}\n",
    "cat/grammar_rules.yaml": "rules:\n- {id: r1, buck_section: '4', affected_dialects: [d1]}\n", "cat/dialects.yaml": "dialects:\n- {id: d1, name: D}\n", "cat/glossary.yaml": "entries:\n- {word: w, dialect: d1, rule_id: r1, buck_ref: {section: '4'}}\n",
}


@case("document_sources", "what a b", [
    ("lexicon", "λόγος", "loɡos"), ("records", "a", "1"), ("records", "b", None), ("array", "a", None), ("array", "c", "5"), ("lines", "a b", None), ("lines", "x", None), ("counts", "a", "3"), ("counts", "b", "1"),
    ("matrix", "a a", "0.0"), ("matrix", "a e", "0.5"), ("matrix", "e a", "0.25"), ("sources", "L1", "S"), ("notes", "logos", "λόγος"), ("sets", "nouns", "a b"),
    ("rules", "A-1", "a.yml"), ("rules", "B-1", "b.yaml"), ("version", "1.10.0", "2"), ("catalogue", "r1", "4"), ("catalogue", "d1", "D"), ("catalogue", "w", '{"section": "4"}'),
])
def document_sources(spark):
    folder = _put(spark, "documents", _DOCS)
    here = _local(folder)
    r, d, g = documents.catalogue(spark, f"{here}/cat")
    loaded = documents.rules(f"{here}/rules")
    versions = documents.rule_versions(f"{here}/rules")
    sets = documents.key_sets(f"{here}/k.yaml")
    parts = [
        ("lexicon", documents.lexicon(spark, f"{folder}/lex.json"), "headword", "ipa"), ("records", documents.records(spark, f"{folder}/r.jsonl"), "original", "pair_index"),
        ("array", documents.records(spark, f"{folder}/r.json"), "original", "tm_id"), ("lines", documents.query_lines(spark, f"{folder}/q.txt"), "query", "null"),
        ("counts", documents.key_value_counts(spark, f"{folder}/f.json"), "key", "count"), ("matrix", documents.matrix_table(spark, documents.matrix(f"{here}/m.json")), "concat(p1, ' ', p2)", "d"),
        ("sources", documents.source_references(spark, f"{here}/s.yaml"), "entry_id", "refs[0].short_citation"), ("notes", documents.orthographic_entries(spark, f"{here}/o.yaml"), "romanization", "candidate_headwords[0]"),
        ("sets", spark.createDataFrame([(k, " ".join(sorted(v))) for k, v in sets.items()], "k string, v string"), "k", "v"), ("rules", documents.rules_table(spark, loaded), "id", "file"),
        ("version", spark.createDataFrame([(documents.latest_version(versions), len(versions))], "v string, n int"), "v", "n"), ("catalogue", r, "id", "buck_section"), ("catalogue", d, "id", "name"), ("catalogue", g, "word", "buck_ref"),
    ]
    out = None
    for what, df, a, b in parts:
        got = df.select(F.lit(what).alias("what"), F.expr(a).cast("string").alias("a"), F.expr(b).cast("string").alias("b"))
        out = got if out is None else out.unionByName(got)
    return out


@case("exclusions_and_sequences", "what a b", [("kept", "f1", None), ("sentence", "f", "a b"), ("sentence", "f", "c")])
def exclusions_and_sequences(spark):
    files = spark.createDataFrame([("f1", 1), ("f2", 2)], "f string, vol int")
    kept = documents.without(files, spark.createDataFrame([("f2",)], "f string"), ["f"]).select(F.lit("kept").alias("what"), F.col("f").alias("a"), F.lit(None).cast("string").alias("b"))
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["<s>", "lemma=a", "x", "lemma=b", "<s>", "lemma=c"])], "file string, n int, value string")
    return kept.unionByName(documents.sentences_from_lines(lines, "^<s>", "lemma=(.+)").select(F.lit("sentence").alias("what"), F.col("file").alias("a"), F.array_join("tokens", " ").alias("b")))


@case("sqlite_rows", "n forms lemmas", [(1000, 1000, 7)])
def sqlite_rows(spark):
    import os
    import sqlite3

    folder = _local(_put(spark, "sqlite", {"empty": ""}))
    path = f"{folder}/l.db"
    if not os.path.exists(path):
        con = sqlite3.connect(path)
        con.execute("create table lookup(form text, lemma text)")
        con.executemany("insert into lookup values (?, ?)", [(f"f{i}", f"l{i % 7}") for i in range(1000)])
        con.commit()
        con.close()
    got = documents.sqlite_table(spark, path, "lookup", "form string, lemma string", 8)
    return got.agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms"), F.countDistinct("lemma").alias("lemmas"))


# --- sinks and checks -------------------------------------------------------------


@case("sink_round_trips", "what value", [("lines", "2"), ("appended", "4"), ("array", "2"), ("summary", "2/1"), ("pending", "f1"), ("matrix", '{"a": {"b": 1.5}, "b": {"a": 1.5}}'), ("candidates", "x y"), ("same fingerprint", "true"), ("other fingerprint", "true"), ("identity", "a/1")])
def sink_round_trips(spark):
    folder = _put(spark, "sinks", {})
    here = _local(_put(spark, "sinks", {"note": ""}))
    df = spark.createDataFrame([("f1", None), ("f2", "5")], "source_file string, tm_id string")
    seen_df, seen = sinks.with_run_summary(df)
    sinks.write_json_lines(seen_df, f"{folder}/o")
    lines = spark.read.json(f"{folder}/o").count()
    pending = sinks.pending(df, spark.read.json(f"{folder}/o").where("tm_id is not null")).first()["source_file"]
    sinks.write_json_lines(df, f"{folder}/o", append=True)
    sinks.write_json_array(df, f"{here}/array.json")
    with open(f"{here}/array.json", encoding="utf-8") as f:
        array = json.load(f)
    doc = json.loads(sinks.matrix_document(spark.createDataFrame([("a", "b", 1.5)], "a string, b string, score double"), {}))
    cands = sinks.candidate_lists(spark.createDataFrame([(1, 1, "y"), (1, 0, "x")], "t int, rank int, word string"), ["t"], ["rank"], ["word"])
    f = spark.createDataFrame([("p/a", bytearray(b"1")), ("p/b", bytearray(b"2"))], "source_file string, content binary")
    one, two, other = (sinks.fingerprint(x).first()["fingerprint"] for x in (f, f.orderBy("content", ascending=False).repartition(3), f.limit(1)))
    ident = sinks.identities(f).orderBy("name").first()
    rows = {
        "lines": lines, "appended": spark.read.json(f"{folder}/o").count(), "array": len(array), "summary": "{pairs}/{missing_tm}".format(**seen.get), "pending": pending, "matrix": json.dumps(doc["scores"]),
        "candidates": " ".join(x["word"] for x in cands.first()["cands"]), "same fingerprint": str(one == two).lower(), "other fingerprint": str(one != other).lower(), "identity": f"{ident['name']}/{ident['bytes']}",
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "what string, value string")


@case("validation_tables", "what subject reason", [
    ("lexicon", "LSJ-00001", "repeated"), ("lexicon", "x", "id_pattern"), ("lexicon", "x", "no_headword"), ("lexicon", "x", "no_gloss"), ("lexicon", "x", "no_gender"),
    ("catalogue", "d2", "unknown_parent"), ("catalogue", "d2", "unknown_rule"), ("catalogue", "r1", "unknown_dialect"), ("catalogue", "v", "unknown_dialect"),
    ("rules", "bad", "id_pattern"), ("rules", "ABC-001", "no_sides"), ("notes", "1", "ready_but_not_reviewed"), ("notes", "2", "reviewed_without_date"), ("cases", "c", "not_public"), ("cases", "c", "limit"), ("cases", "c", "link"),
    ("document", "x", "enum_pos"), ("document", "x", "unknown_extra"), ("document", "y", "no_headword"), ("document", "z", "pattern_id"),
])
def validation_tables(spark):
    lex = spark.createDataFrame([("LSJ-00001", "a", "a", "g", "noun", "feminine"), ("LSJ-00001", "a", "a", "g", "verb", None), ("x", " ", "a", None, "noun", None)], "id string, headword string, ipa string, gloss string, pos string, gender string")
    r = spark.createDataFrame([("r1", ["d1", "dx"])], "id string, affected_dialects array<string>")
    d = spark.createDataFrame([("d1", None, ["r1"]), ("d2", "d9", ["r9"])], "id string, parent string, rules array<string>")
    g = spark.createDataFrame([("w", "d1", None), ("v", "zz", "r1")], "word string, dialect string, rule_id string")
    files = spark.createDataFrame([("bad", "a", "b", False), ("ABC-001", "", None, False)], "id string, input string, output string, is_insertion boolean")
    n = spark.createDataFrame([(1, "a", "draft", True, None), (2, "b", "expert_reviewed", False, None)], "entry_id int, original string, review_status string, citation_ready boolean, reviewed_at string")
    c = spark.createDataFrame([("c", "private", "i", 500, "see https://x")], "case_id string, visibility string, input_form string, max_candidates int, note string")
    doc = spark.createDataFrame([("x", "a", "nomen", "e"), ("y", None, "noun", None), ("z1", "b", "verb", None)], "id string, headword string, pos string, extra string").withColumn("id", F.regexp_replace("id", "z1", "z"))
    schema = {"required": ["id", "headword"], "additionalProperties": False, "properties": {"id": {"type": "string", "pattern": "^[xy]$"}, "headword": {"type": "string", "minLength": 1}, "pos": {"enum": ["noun", "verb", None]}}}
    parts = [
        ("lexicon", validation.lexicon(lex)), ("catalogue", validation.catalogue(r, d, g)), ("rules", validation.rule_file(files)), ("notes", validation.review(n)), ("cases", validation.cases(c)), ("document", validation.document(doc, schema)),
    ]
    out = None
    for what, df in parts:
        got = df.select(F.lit(what).alias("what"), "subject", "reason")
        out = got if out is None else out.unionByName(got)
    return out


@case("lexicon_merge", "id cat", [(1, "x"), (2, "y"), (3, "x")])
def lexicon_merge(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, cat string")
    return catalogue.merge_lexicons(rows, spark.createDataFrame([(2, "y"), (3, "x")], "id int, cat string"))


@case("rule_annotations", "hit step rule_id catalogue_id", [("h", 0, "R", "c1"), ("h", 0, "R", "c2"), ("h", 1, "Q", "c1")])
def rule_annotations(spark):
    steps = spark.createDataFrame([("h", 0, "R"), ("h", 1, "Q"), ("h", 2, "R")], "hit string, step int, rule_id string")
    cites = spark.createDataFrame([("R", "4"), ("R", "5"), ("Q", "4")], "rule_id string, section string")
    return catalogue.annotations(steps, cites, spark.createDataFrame([("4", "c1"), ("5", "c2"), ("6", "c3")], "section string, catalogue_id string"))


@case("note_messages", "headword kinds messages", [("λόγος", "beginner_aid", "Read λώγος as a form of λόγος. The spelling is late."), ("λόφος", "", "")])
def note_messages(spark):
    hits = spark.createDataFrame([("λώγος", "λόγος"), ("λώγος", "λόφος")], "query string, headword string")
    entries = spark.createDataFrame([("λώγος", "λόγος", ["λόγος"], "beginner_aid", ["late_spelling", "none"], "high")], "original string, normalized string, candidate_headwords array<string>, kind string, tags array<string>, confidence string")
    return notes.orthographic_notes(hits, entries).select("headword", F.array_join("notes.kind", ",").alias("kinds"), F.array_join("notes.message", ",").alias("messages"))


@case("trusted_paths", "path ok", [("inside", "true"), ("outside", "false")])
def trusted_paths(spark):
    from lexiloom.facade import trusted

    here = _local(_put(spark, "paths", {"in/x.yaml": "x", "out.yaml": "x"}))

    def ok(path: str) -> bool:
        try:
            trusted(path, [f"{here}/in"])
        except ValueError:
            return False
        return True

    return spark.createDataFrame([("inside", ok(f"{here}/in/x.yaml")), ("outside", ok(f"{here}/in/../out.yaml"))], "path string, ok boolean")
