"""Constraint checks as violation tables: empty means valid.

Every check gives (subject, reason) rows, so that large tables are checked where they lie;
``assert_valid`` raises on the first few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of speech, those that need a gender, genders.
POS = ("noun", "verb", "adjective", "adverb", "pronoun", "preposition", "conjunction", "particle", "interjection", "numeral", "article", "participle")
GENDERED = ("noun", "pronoun", "adjective", "article", "participle", "numeral")
GENDERS = ("masculine", "feminine", "neuter", "common")


def violations(rows: DataFrame, subject: str, **tests: Column) -> DataFrame:
    """(subject, reason) of every named test that holds; an unknown (null) test does not."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(reasons).alias("reason"))


def repeated(rows: DataFrame, key: str, reason: str = "repeated") -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("subject")).count().where("count > 1").select("subject", F.lit(reason).alias("reason"))


def dangling(rows: DataFrame, subject: str, column: Column, keys: DataFrame, key: str, reason: str) -> DataFrame:
    """Rows whose value (or any value of an array column) names no key."""
    known = keys.select(F.col(key).alias("_key")).distinct()
    named = rows.select(F.col(subject).cast("string").alias("subject"), column.alias("_v")).where("_v is not null")
    return named.join(known, F.col("_v") == F.col("_key"), "left_anti").select("subject", F.lit(reason).alias("reason"))


def lexicon(rows: DataFrame) -> DataFrame:
    """Lexicon rows: id pattern, required fields, known part of speech, gender where needed, one row per id."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = violations(
        rows, "id", id_pattern=~F.coalesce(F.col("id"), F.lit("")).rlike(r"^[A-Z]+-[0-9]{5,}$"), no_headword=blank("headword"), no_ipa=blank("ipa"), no_gloss=blank("gloss"),
        unknown_pos=~F.coalesce(F.col("pos").isin(*POS), F.lit(False)), no_gender=F.col("pos").isin(*GENDERED) & F.col("gender").isNull(), unknown_gender=~F.col("gender").isin(*GENDERS),
    )
    return checks.unionByName(repeated(rows, "id"))


def document(rows: DataFrame, schema: dict) -> DataFrame:
    """(subject, reason) by a JSON schema of flat objects: required, type, enum, pattern, minLength and additional properties.

    ``rows`` has ``id`` and one column for each property it holds, null where absent.
    """
    tests: dict[str, Column] = {}
    props = schema.get("properties", {})
    for name, rule in props.items():
        if name not in rows.columns:
            if name in schema.get("required", ()):
                tests[f"no_{name}"] = F.lit(True)
            continue
        c = F.col(name)
        if name in schema.get("required", ()):
            tests[f"no_{name}"] = c.isNull()
        if "enum" in rule:
            tests[f"enum_{name}"] = ~c.isin([v for v in rule["enum"] if v is not None])
        if "pattern" in rule:
            tests[f"pattern_{name}"] = ~c.rlike(rule["pattern"])
        if "minLength" in rule:
            tests[f"short_{name}"] = F.length(c) < rule["minLength"]
        kinds = rule.get("type", [])
        if "null" not in ([kinds] if isinstance(kinds, str) else kinds) and name in schema.get("required", ()):
            tests.setdefault(f"no_{name}", c.isNull())
    if schema.get("additionalProperties") is False:
        for extra in sorted(set(rows.columns) - set(props)):
            tests[f"unknown_{extra}"] = F.col(extra).isNotNull()
    return violations(rows, "id", **tests)


def rule_file(rules: DataFrame) -> DataFrame:
    """Rules: id pattern, some input or output, empty input only for insertions, one row per id."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = violations(
        rules, "id", id_pattern=~F.coalesce(F.col("id"), F.lit("")).rlike(r"^[A-Z]{3}-[0-9]{3}$"), no_sides=empty("input") & empty("output"),
        empty_input=empty("input") & ~empty("output") & ~F.coalesce(F.col("is_insertion"), F.lit(False)),
    )
    return checks.unionByName(repeated(rules, "id"))


def catalogue(rules: DataFrame, dialects: DataFrame, glossary: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """Uniqueness and foreign keys of the three catalogue tables; ``rings`` from the hierarchy are cycles."""
    parts = [
        repeated(rules, "id", "repeated_rule"),
        repeated(dialects, "id", "repeated_dialect"),
        dangling(dialects, "id", F.col("parent"), dialects, "id", "unknown_parent"),
        dangling(dialects.select("id", F.explode("rules").alias("r")), "id", F.col("r"), rules, "id", "unknown_rule"),
        dangling(rules.select("id", F.explode("affected_dialects").alias("d")), "id", F.col("d"), dialects, "id", "unknown_dialect"),
        dangling(glossary, "word", F.col("dialect"), dialects, "id", "unknown_dialect"),
        dangling(glossary, "word", F.col("rule_id"), rules, "id", "unknown_rule"),
    ]
    if rings is not None:
        parts.append(rings.select(F.col("v").alias("subject"), F.lit("cycle").alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def review(notes: DataFrame, key: str = "entry_id") -> DataFrame:
    """Review metadata: a citation-ready or reviewed note names when; one not reviewed is not citation-ready."""
    reviewed = F.col("review_status") == "expert_reviewed"
    return violations(
        notes, key, ready_but_not_reviewed=F.col("citation_ready") & ~reviewed, reviewed_without_date=reviewed & F.col("reviewed_at").isNull(),
        dated_but_not_reviewed=~reviewed & F.col("reviewed_at").isNotNull(), no_text=F.coalesce(F.trim("original"), F.lit("")) == "",
    )


def cases(expected: DataFrame) -> DataFrame:
    """Evaluation cases: public, with an input and a sane limit, and no links in their notes."""
    return violations(
        expected, "case_id", not_public=F.coalesce(F.col("visibility"), F.lit("")) != "public", no_input=F.coalesce(F.trim("input_form"), F.lit("")) == "",
        limit=~F.col("max_candidates").between(1, 100), link=F.col("note").rlike("(?i)https?://"),
    )


def assert_valid(found: DataFrame, shown: int = 5) -> None:
    some = found.limit(shown).collect()
    if some:
        raise ValueError("; ".join(f"{r['subject']}: {r['reason']}" for r in some))


def complete_matrix(seed: dict[str, dict[str, float]], derived: dict[str, tuple[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """A seed made symmetric with a zero diagonal; derived phones take a base phone's row, at a set distance from it.

    Later cells win over their mirror; a pair in neither direction raises.
    """
    base_of = {p: b for p, (b, _) in (derived or {}).items()}
    root = lambda p: base_of.get(p, p)
    cells: dict[tuple[str, str], float] = {}
    for a, row in seed.items():
        for b, d in row.items():
            cells[a, b] = cells[b, a] = float(d)
    phones = [*seed, *[p for p in base_of if p not in seed]]
    out: dict[str, dict[str, float]] = {a: {} for a in phones}
    for a in phones:
        for b in phones:
            if a == b:
                d = 0.0
            elif (a, b) in cells:
                d = cells[a, b]
            elif root(a) == b or root(b) == a:
                d = (derived or {})[a if root(a) == b else b][1]
            elif root(a) == root(b):
                d = 0.0
            elif (root(a), root(b)) in cells:
                d = cells[root(a), root(b)]
            else:
                raise ValueError(f"no distance between {a} and {b}")
            out[a][b] = d
    return out
