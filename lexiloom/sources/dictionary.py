"""Dictionary entries: evidence is gathered from the XML, decisions are Columns.

Python only walks each entry and reports what stands where.  Headword, part of speech,
gender and dialect are then ``coalesce`` cascades in the plan, so a rule can be
inspected, replaced or measured by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.sources.xml import _rows, _tag

EVIDENCE = (
    "source_file string, n int, xml_id string, type string, key string, orths array<string>, gender_text string, itypes array<string>, pos_text string, "
    "inflected boolean, intro string, sense_intros array<string>, post_gloss array<string>, glosses array<string>, greek_forms int"
)

# Abbreviations of parts of speech, genders by article, dialects.
POS_LABELS = (
    ("article", "Art\\.|Article"), ("pronoun", "Pron\\.|Pronoun"), ("preposition", "Prep\\.|Preposition"), ("conjunction", "Conj\\.|Conjunction"),
    ("particle", "Part\\.|Particle"), ("interjection", "Interj\\.|Interjection"), ("numeral", "Num\\.|Numeral"), ("participle", "Partic\\.|Participle"),
)
EXPLICIT = POS_LABELS + (("adjective", "Adj\\."), ("adverb", "Adv\\."), ("noun", "Subst\\."), ("verb", "Verb|v\\."))
ARTICLES = (("masculine", "o(", "ὁ"), ("feminine", "h(", "ἡ"), ("neuter", "to/", "τό"))
DIALECTS = (("attic", "Att\\."), ("ionic", "Ion\\.|Ep\\."), ("doric", "Dor\\.|Lacon\\."), ("aeolic", "Aeol\\."))
NEEDS_GENDER = ("noun", "adjective", "pronoun", "article", "numeral", "participle")
ONE_LETTER = ("article", "pronoun", "interjection")
GLOSS_LENGTH = 200


def _text(e: ET.Element) -> str:
    return "".join(e.itertext()).strip()


def _squeeze(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def _around_glosses(sense: ET.Element) -> tuple[str, str]:
    """The sense's prose before its first gloss and after it; glosses themselves are left out."""
    before: list[str] = [sense.text or ""]
    after: list[str] = []
    seen = False
    for x in sense:
        part = after if seen else before
        if _tag(x) == "tr":
            seen = True
        else:
            part.append("".join(x.itertext()))
        (after if seen else before).append(x.tail or "")
    return _squeeze(before), _squeeze(after) if seen else ""


def _evidence(path: str, root: ET.Element) -> Iterator[tuple]:
    n = 0
    for e in root.iter():
        if _tag(e) != "entryFree":
            continue
        head: list[ET.Element] = []
        for x in e:
            if _tag(x) == "sense":
                break
            head.append(x)
        greek = [x for x in head if _tag(x) in ("orth", "foreign") and x.get("lang", "greek") == "greek"]
        block = head[head.index(greek[0]) + 1 :] if greek else []
        own = block[: next((i for i, x in enumerate(block) if x in greek), len(block))]
        senses = [x for x in e if _tag(x) == "sense"]
        around = [_around_glosses(s) for s in senses]
        glosses = next((g for g in ([_text(t).strip(", ") for t in s.iter() if _tag(t) == "tr"] for s in senses) if any(g)), [_text(t).strip(", ") for t in e if _tag(t) == "tr"])
        full = [x for x in e.iter() if _tag(x) == "orth" and x.get("extent") == "full"]
        intro = _squeeze([e.text or "", *[p for x in head for p in ("".join(x.itertext()), " ", x.tail or "")]])
        yield (
            path, n, e.get("id") or "", e.get("type") or "", e.get("key") or "", [_text(x) for x in (*full, *[x for x in e.iter() if _tag(x) == "orth"])],
            next((_text(x) for x in head if _tag(x) == "gen"), None), [_text(x) for x in own if _tag(x) == "itype"], next((_text(x) for x in e.iter() if _tag(x) == "pos"), None),
            any(_tag(x) in ("tns", "mood") for x in e.iter()), intro, [a for a, _ in around], [b for _, b in around], [g for g in glosses if g], len(greek),
        )
        n += 1


def evidence(files: DataFrame) -> DataFrame:
    """What each entry of (source_file, content) holds, by place."""
    return _rows(files, EVIDENCE, _evidence)


def _key(c: Column) -> Column:
    """The key without homonym numbers and quantity marks."""
    return F.translate(F.regexp_replace(c, r"\d+$", ""), "^_", "")


def _label(text: Column, labels: tuple, tail: str) -> Column:
    """The part of speech labelled first in the text; one after an Attic label goes before others."""
    found = [
        F.when(pos > 0, F.struct(F.when(text.rlike(rf"(?i)\bAtt(?:\.|ic\b)[^;:]{{0,30}}\b(?:{p}){tail}"), 0).otherwise(1).alias("a"), pos.alias("at"), F.lit(name).alias("pos")))
        for name, p in labels
        for pos in [F.regexp_instr(text, F.lit(rf"(?i)\b(?:{p}){tail}"))]
    ]
    return F.array_min(F.array_compact(F.array(*found)))


_TAIL = r"(?=$|[.,;:]|\s+(?:of|with|gen\.|dat\.|acc\.|c\.))"


def _first_label(texts: Column) -> Column:
    """The best label over several texts: Attic ones first, then by text, then by place."""
    each = F.transform(texts, lambda t, i: F.when(_label(t, POS_LABELS, _TAIL).isNotNull(), F.struct(_label(t, POS_LABELS, _TAIL)["a"].alias("a"), i.alias("i"), _label(t, POS_LABELS, _TAIL)["at"].alias("at"), _label(t, POS_LABELS, _TAIL)["pos"].alias("pos"))))
    return F.array_min(F.array_compact(each))["pos"]


def part_of_speech(numerals: list[str] | None = None) -> Column:
    """Nine rules in order: tag, prose label, numeral, gender, adverb ending, adjective endings, verb, late label, participle."""
    key = _key(F.col("key"))
    tag = F.trim(F.rtrim(F.col("pos_text")))
    explicit = F.coalesce(*[F.when(tag.rlike(rf"(?i)^(?:{p})\.?$") | F.concat(tag, F.lit(".")).rlike(rf"(?i)^(?:{p})$"), name) for name, p in EXPLICIT])
    prose = _first_label(F.concat(F.array("intro"), F.col("sense_intros")))
    participial = F.col("intro").rlike(r"(?i)\b(?:part|partic|participle)\.?\s+of\b")
    plain = F.transform("itypes", lambda t: F.regexp_replace(F.lower(F.trim(t)), r"[()/=\\+|'*,;:.\[\]\s]", ""))
    endings = lambda *xs: F.arrays_overlap(plain, F.array(*[F.lit(x) for x in xs]))
    adjective = (endings("on") & (endings("a", "h") | F.regexp_replace(key, r"[()/=\\+|'*]", "").endswith("os"))) | endings("es")
    neuter_plural = F.col("intro").rlike(r"ta/|τά")
    return F.coalesce(
        explicit,
        prose,
        F.when(key.isin(numerals or []), "numeral"),
        F.when(F.col("gender_text").isNotNull(), F.when(participial & neuter_plural, "participle").otherwise("noun")),
        F.when(key.endswith("ws") | key.endswith("w=s") | key.endswith("ei/"), "adverb"),
        F.when(adjective, "adjective"),
        F.when(F.col("inflected") & F.rtrim(F.translate(key, ":", " ")).rlike("(?:w|mai|mi)$"), "verb"),
        _first_label(F.col("post_gloss")),
        F.when(participial, "participle"),
    )


def gender(pos: Column, common: list[str] | None = None) -> Column:
    """By the article; common where several forms head a pronoun, for listed nouns, and where it is needed but unknown."""
    g = F.trim("gender_text")
    named = F.coalesce(*[F.when(g.startswith(beta) | (g == uni), name) for name, beta, uni in ARTICLES])
    return (
        F.when(pos.isin("pronoun", "article", "numeral") & (F.col("greek_forms") > 1), "common")
        .when((pos == "noun") & _key(F.col("key")).isin(common or []), "common")
        .when(pos.isin(*NEEDS_GENDER), F.coalesce(named, F.lit("common")))
        .otherwise(named)
    )


def dialect() -> Column:
    """The dialect labelled in the heading, Attic before others; a label after a second Greek form is the variant's."""
    head = F.when(F.col("greek_forms") <= 1, F.col("intro")).otherwise(F.lit(""))
    return F.coalesce(*[F.when(head.rlike(rf"(?:{p})(?!\w)"), name) for name, p in DIALECTS], F.lit("attic"))


def headword() -> Column:
    """The first of key and orthographies that converts."""
    tries = F.concat(F.array("key"), F.col("orths"))
    converted = F.transform(F.filter(F.transform(tries, lambda t: _key(t)), lambda t: (t != "") & ~t.rlike(S.DANGLING)), lambda t: F.when(t.rlike(r"^[\x00-\x7f]+$"), S.beta_to_unicode(t)).otherwise(t))
    return F.get(converted, F.lit(0))


def gloss() -> Column:
    whole = F.array_join("glosses", ", ")
    cut = F.regexp_replace(F.substring(whole, 1, GLOSS_LENGTH - 3), r"\p{M}+$", "")
    return F.when(F.length(whole) > GLOSS_LENGTH, F.concat(cut, F.lit("..."))).otherwise(whole)


def entries(files: DataFrame, numerals: list[str] | None = None, common: list[str] | None = None) -> DataFrame:
    """Lexicon rows of a dictionary: main Attic entries with headword, gloss and part of speech; of one id the first holds."""
    e = evidence(files).where(F.col("type").isin("", "main") & F.col("xml_id").rlike(r"^n?\d+$"))
    e = e.withColumns({"id": F.format_string("LSJ-%06d", F.regexp_replace("xml_id", "^n", "").cast("bigint")), "headword": headword(), "gloss": gloss(), "pos": part_of_speech(numerals), "dialect": dialect()})
    e = e.where("headword <> '' and gloss <> '' and pos is not null and dialect = 'attic'")
    e = e.where((F.length(F.trim("headword")) > 1) | F.col("pos").isin(*ONE_LETTER))
    first = F.row_number().over(Window.partitionBy("id").orderBy("source_file", "n"))
    e = e.withColumn("_first", first).where("_first = 1")
    e = e.withColumns({"gender": gender(F.col("pos"), common), "transliteration": S.transliterate("headword"), "ipa": S.to_ipa("headword")})
    return e.where("transliteration <> '' and ipa <> ''").select("id", "headword", "transliteration", "ipa", "pos", "gender", "gloss", "dialect")
