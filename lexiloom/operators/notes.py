"""Orthographic notes and hit prose: templates filled natively.

Texts are templates in two languages, looked up by kind; notes are joined to hits by the
composed query form and the candidate headword.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.unicode import nfc

#: Own templates: kind -> language -> text.
NOTE_TEXTS = {
    "orthographic_correspondence": {"en": "The spelling {original} corresponds to {normalized}.", "ja": "表記 {original} は {normalized} に対応します。"},
    "beginner_aid": {"en": "Read {original} as a form of {normalized}.", "ja": "{original} は {normalized} の語形として読めます。"},
    "pre_reform": {"en": "Before the spelling reform {original} stood for {normalized}.", "ja": "綴り改革以前は {original} が {normalized} を表しました。"},
}
TAG_TEXTS = {"historical_context": {"en": "This is a matter of its period.", "ja": "時代的な表記です。"}, "late_spelling": {"en": "The spelling is late.", "ja": "後代の綴りです。"}}
SUMMARY = {
    "en": {"exact": "same pronunciation", "rules": "%d named changes", "observed": "%d unexplained differences", "both": "%d named changes and %d unexplained differences"},
    "ja": {"exact": "発音が一致", "rules": "規則 %d 件", "observed": "未説明の差異 %d 件", "both": "規則 %d 件と未説明の差異 %d 件"},
}


def _by_kind(texts: dict[str, dict[str, str]], lang: str) -> Column:
    return F.create_map(*[F.lit(x) for k, v in texts.items() for x in (k, v.get(lang, v["en"]))])


def orthographic_notes(hits: DataFrame, entries: DataFrame, lang: str = "en") -> DataFrame:
    """``hits`` (query, headword, ...) with ``notes``: what the entries for the query say of the headword; empty for none."""
    text = F.try_element_at(_by_kind(NOTE_TEXTS, lang), F.col("kind"))
    message = F.replace(F.replace(text, F.lit("{original}"), F.col("original")), F.lit("{normalized}"), F.col("normalized"))
    extra = F.array_join(F.array_compact(F.transform("tags", lambda t: F.try_element_at(_by_kind(TAG_TEXTS, lang), t))), " ")
    said = entries.withColumns({"_q": nfc("original"), "message": F.trim(F.concat_ws(" ", message, extra))})
    notes = said.select("_q", F.explode("candidate_headwords").alias("_h"), F.struct("kind", "message", "confidence").alias("note")).distinct()
    lists = notes.groupBy("_q", "_h").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    joined = hits.withColumns({"_q": nfc("query"), "_h": F.col("headword")}).join(lists, ["_q", "_h"], "left").drop("_q", "_h")
    return joined.withColumn("notes", F.coalesce("notes", F.array().cast(joined.schema["notes"].dataType)))


def promoted_bucket(bucket: Column, notes: Column) -> Column:
    """An orthographic correspondence makes a candidate Supported."""
    return F.when(F.exists(notes, lambda n: n["kind"] == "orthographic_correspondence"), "Supported").otherwise(bucket)


def alignment_summary(same: Column, n_rules: Column, n_observed: Column, lang: str = "en") -> Column:
    t = SUMMARY.get(lang, SUMMARY["en"])
    return (
        F.when(same & (n_rules + n_observed == 0), t["exact"])
        .when((n_rules > 0) & (n_observed > 0), F.format_string(t["both"], n_rules, n_observed))
        .when(n_rules > 0, F.format_string(t["rules"], n_rules))
        .otherwise(F.format_string(t["observed"], n_observed))
    )


def why(headword: Column, confidence: Column, summary: Column, lang: str = "en") -> Column:
    """One sentence on why a headword is a candidate."""
    pattern = "%s: similarity %.2f, %s." if lang == "en" else "%s：類似度 %.2f、%s。"
    return F.format_string(pattern, headword, confidence, summary)


def explained_by_ids(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """``pairs`` (source, target, rule_ids, distance) with ``steps`` of the named rules, each at position -1, and their ``prose``.

    Steps keep the order of the ids; an id that ``rules`` (id, input, output) lacks is left out.
    """
    named = pairs.select("source", "target", "rule_ids", F.posexplode("rule_ids").alias("_at", "rule_id")).join(rules.select(F.col("id").alias("rule_id"), "input", "output"), "rule_id")
    step = F.struct("_at", F.col("rule_id"), F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"), F.lit(-1).alias("position"))
    lists = named.groupBy("source", "target", "rule_ids").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    keys = ["source", "target", "rule_ids"]
    out = pairs.join(lists, keys, "left").withColumn("steps", F.coalesce("steps", F.array().cast(lists.schema["steps"].dataType)))
    return out.withColumn("prose", prose(F.col("source"), F.col("target"), F.col("steps"), F.col("distance")))


def prose(source: Column, target: Column, steps: Column, distance: Column) -> Column:
    """The canonical sentence of an explanation given by rule ids."""
    chain = F.array_join(F.transform(steps, lambda s: F.concat(s["rule_id"], F.lit(" /"), s["input"], F.lit("/ to /"), s["output"], F.lit("/"))), "; ")
    return F.when(F.size(steps) == 0, F.format_string("/%s/ and /%s/ differ by %.3f; no rule applies.", source, target, distance)).otherwise(
        F.format_string("/%s/ becomes /%s/ by %s (distance %.3f).", source, target, chain, distance)
    )
