"""XML corpora: spelling choices, treebank words, running text, flagged pairs.

Files are read whole (``binaryFile``) and parsed per Arrow batch with the standard library's
parser; documents that declare entities are refused.  A file that does not parse gives one
row in ``failures`` and is read as far as its tags allow: an element left open ends with
the one around it, an end tag without a start is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.functions.unicode import nfc

CHOICE = "source_file string, original string, regularized string, tm_id string, pair_index int"
WORD = "source_file string, doc string, date_not_before string, date_not_after string, sent string, wid string, form_orig string, form_reg string, lemma_reg string, lemma_orig string, postag string, lang string"
LINE = "source_file string, n int, text string"


def files(spark: SparkSession, path: str, suffix: str = "*.xml") -> DataFrame:
    """(source_file, content), recursively."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    return got.select(F.col("path").alias("source_file"), "content")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def parse(content: bytes) -> ET.Element:
    if b"<!ENTITY" in content[:65536]:
        raise ValueError("documents that declare entities are refused")
    return ET.fromstring(content)


_MARKUP = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<data>.*?)\]\]>|<![^>]*>|</\s*(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def recovered(content: bytes) -> ET.Element:
    """The tree of a malformed document: open elements end with the one around them, stray end tags are passed over."""
    from html import unescape

    text = content.decode("utf-8-sig", "replace")
    build, open_tags, at = ET.TreeBuilder(), ["recovered"], 0
    build.start("recovered", {})
    for m in _MARKUP.finditer(text):
        build.data(unescape(text[at : m.start()]))
        at = m.end()
        if m["data"] is not None:
            build.data(m["data"])
        elif m["start"]:
            build.start(m["start"].rpartition(":")[2], {k.rpartition(":")[2]: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m["attrs"])})
            if m["empty"]:
                build.end(m["start"])
            else:
                open_tags.append(m["start"])
        elif m["end"] and m["end"] in open_tags[1:]:
            while (name := open_tags.pop()) != m["end"]:
                build.end(name)
            build.end(name)
    if "<" not in text[at:]:
        build.data(unescape(text[at:]))
    for name in reversed(open_tags):
        build.end(name)
    return build.close()


def _rows(df: DataFrame, schema: str, rows: Callable[[str, ET.Element], Iterator[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["source_file"], b["content"], strict=True):
                try:
                    root = parse(bytes(content))
                except ValueError:
                    continue
                except ET.ParseError:
                    root = recovered(bytes(content))
                out += rows(path, root)
            yield pd.DataFrame(out, columns=names).astype(object)

    return df.select("source_file", "content").mapInPandas(run, schema)


def failures(df: DataFrame) -> DataFrame:
    """(source_file, reason) of files that do not parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["source_file"], b["content"], strict=True):
                try:
                    parse(bytes(content))
                except (ET.ParseError, ValueError) as x:
                    out.append((path, str(x)))
            yield pd.DataFrame(out, columns=["source_file", "reason"])

    return df.select("source_file", "content").mapInPandas(run, "source_file string, reason string")


def document_id(root: ET.Element, path: str) -> str | None:
    """The header's first idno of a papyrus number type, else the first digits of the file's name."""
    for e in root.iter():
        if _tag(e) == "teiHeader":
            for x in e.iter():
                if _tag(x) == "idno" and (x.get("type") or "").lower() in ("tm", "trismegistos") and (x.text or "").strip():
                    return x.text.strip()
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    m = re.search(r"\d+", stem)
    return m.group(0) if m else None


def _choices(path: str, root: ET.Element) -> Iterator[tuple]:
    ident = document_id(root, path)
    for c in root.iter():
        if _tag(c) != "choice":
            continue
        side = {"orig": [], "reg": []}
        for x in c:
            text = "".join(x.itertext()).strip()
            if _tag(x) in side and text:
                side[_tag(x)].append(text)
        # unequal numbers cannot be paired
        if len(side["orig"]) == len(side["reg"]):
            for i, (a, b) in enumerate(zip(side["orig"], side["reg"], strict=True)):
                yield path, a, b, ident, i


def choices(df: DataFrame) -> DataFrame:
    """Spelling pairs: the n-th orig with the n-th reg of each choice."""
    return _rows(df, CHOICE, _choices)


def _words(path: str, root: ET.Element) -> Iterator[tuple]:
    meta = next((e for e in root.iter() if _tag(e) == "document_meta"), None)
    of = lambda k, d="": (meta.get(k) if meta is not None else None) or d
    for s in root.iter():
        if _tag(s) == "sentence":
            for w in s.iter():
                if _tag(w) == "word":
                    g = lambda k, w=w: (w.get(k) or "").strip()
                    yield path, of("name", path.rsplit("/", 1)[-1]), of("date_not_before"), of("date_not_after"), s.get("id"), w.get("id"), g("form_orig"), g("form_reg"), g("lemma_reg"), g("lemma_orig"), g("postag_reg"), g("lang")


def treebank(df: DataFrame) -> DataFrame:
    """Evaluation tokens: Greek words with form and lemma, no punctuation or lost text, with their stratum."""
    w = _rows(df, WORD, _words)
    for c in ("lemma_reg", "lemma_orig"):
        w = w.withColumn(c, F.trim(F.regexp_replace(c, r"\|[^|]*\|", "")))
    greek = "[Ͱ-Ͽἀ-῿]"
    w = w.where(F.col("lang").isin("", "grc") & ~F.col("postag").startswith("u") & F.col("form_orig").rlike(greek) & (F.col("form_reg") != "") & F.col("lemma_reg").rlike(greek))
    w = w.where(~F.col("form_orig").rlike(r"[\[\]]") & ~F.col("lemma_reg").contains("_"))
    kind = S.markup_class("form_orig", "form_reg")
    same = nfc("lemma_orig") == nfc("lemma_reg")
    stratum = F.when(kind == "variant", F.when(same, "variant_ortho").otherwise("variant_lex")).otherwise(kind)
    return w.select(
        "doc", "date_not_before", "date_not_after", "sent", "wid", nfc("form_orig").alias("form_orig"), nfc("form_reg").alias("form_reg"),
        nfc("lemma_reg").alias("lemma_gold"), nfc("lemma_orig").alias("lemma_orig"), "postag", stratum.alias("stratum"),
    )


#: Elements whose text is no running text, and those that break a line.
OPAQUE = frozenset({"teiHeader", "note", "rdg", "del", "orig", "sic", "figure", "desc", "certainty"})
BREAKS = frozenset({"ab", "p", "div", "lg", "l", "head", "gap"})


def _running(path: str, root: ET.Element) -> Iterator[tuple]:
    """Lines of the body: a line break within a word glues it, gaps and blocks end a line."""
    parts: list[str] = []
    flat = lambda t: re.sub(r"\s+", " ", t or "")
    # an explicit stack keeps deep documents from exhausting the interpreter's own
    todo: list = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            parts.append(e)
            continue
        tag = _tag(e)
        end = "\n" if tag in BREAKS else ""
        if tag in OPAQUE:
            todo.append(flat(e.tail))
            continue
        if tag == "lb":
            parts.append("" if e.get("break") == "no" else " ")
        elif end:
            parts.append(end)
        todo.append(flat(e.tail))
        todo.append(end)
        for x in reversed(list(e)):
            todo.append(x)
        todo.append(flat(e.text))
    for n, line in enumerate(x for x in (re.sub(r"\s+", " ", p).strip() for p in "".join(parts).split("\n")) if x):
        yield path, n, line


def running_text(df: DataFrame) -> DataFrame:
    """(source_file, n, text): regularised running text by line."""
    return _rows(df, LINE, _running)


PAIR = "source_file string, doc string, n int, form string, reg string, flags array<string>"
#: Markup inside a pair that makes it less certain.
FLAGS = frozenset({"gap", "supplied", "ex", "expan", "unclear", "surplus", "num", "abbr"})


def _flagged(path: str, root: ET.Element) -> Iterator[tuple]:
    doc = document_id(root, path)
    n = 0
    for c in root.iter():
        if _tag(c) != "choice":
            continue
        by = {_tag(x): x for x in reversed(list(c))}  # the first of each kind
        for a, b in (("orig", "reg"), ("sic", "corr")):
            if a in by and b in by:
                form, reg = ("".join(by[x].itertext()).strip() for x in (a, b))
                flags = {_tag(x) for side in (a, b) for x in by[side].iter()} & FLAGS
                yield path, doc, n, form, reg, sorted(flags | ({"corr"} if a == "sic" else set()))
                n += 1


def flagged_pairs(df: DataFrame) -> DataFrame:
    """Spelling and correction pairs with the markup found inside them."""
    return _rows(df, PAIR, _flagged)


def pair_drop_reasons(pairs: DataFrame, include_corrections: bool = False, strict: bool = True) -> DataFrame:
    """``pairs`` with ``reasons``: every reason to leave a pair out; empty means keep."""
    from lexiloom.operators.catalogue import drop_reasons

    greek, has = r"^[Ͱ-Ͽἀ-῿̀-ͯʼ’']+$", lambda *fs: F.arrays_overlap("flags", F.array(*[F.lit(f) for f in fs]))
    tests = {
        "empty": (F.trim("form") == "") | (F.trim("reg") == ""), "same": nfc("form") == nfc("reg"), "not_one_word": F.col("form").rlike(r"\s") | F.col("reg").rlike(r"\s"),
        "not_greek": ~F.col("form").rlike(greek) | ~F.col("reg").rlike(greek), "lost_text": has("gap"), "abbreviated": has("ex", "expan", "abbr"),
    }
    if not include_corrections:
        tests["correction"] = has("corr")
    if strict:
        tests["uncertain"] = has("supplied", "unclear", "surplus")
    return pairs.withColumn("reasons", drop_reasons(**tests))
