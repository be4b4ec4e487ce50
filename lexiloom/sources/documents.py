"""Small documents: lexicon and matrix JSON, record files, rule, catalogue and note YAML, text lines.

Lexicons and record files are read by Spark's own readers.  Rule sets, matrices and
catalogues are small reference documents: they are parsed on the driver, checked against
``MAX_BYTES`` and turned into DataFrames.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest reference document parsed on the driver.
MAX_BYTES = 64 * 1024 * 1024

#: Lines of one file whose sentences one task numbers.
LINE_BLOCK = 100_000

LEMMA = "id string, headword string, transliteration string, ipa string, pos string, gender string, gloss string, dialect string"
RECORD = "original string, regularized string, source_file string, tm_id string, pair_index int"
RULE = "file string, ordinal int, id string, name_en string, input string, output string, context string, dialects array<string>, is_insertion boolean, lemma_constraints string"


def _text(path: str | Path) -> str:
    p = Path(path)
    if p.stat().st_size > MAX_BYTES:
        raise ValueError(f"{p} is larger than a reference document may be ({MAX_BYTES} bytes)")
    return p.read_text(encoding="utf-8")


def _yaml(path: str | Path) -> dict:
    import yaml

    loaded = yaml.safe_load(_text(path))
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} must hold a mapping")
    return loaded


def lexicon(spark: SparkSession, path: str, schema: str = LEMMA) -> DataFrame:
    """The ``lemmas`` of one lexicon document; anything but objects there is an error."""
    doc = spark.read.schema(f"schema_version string, lemmas array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(F.inline("lemmas"))


def records(spark: SparkSession, path: str, fmt: str = "auto", schema: str = RECORD) -> DataFrame:
    """Records from JSON lines or a JSON array; ``auto`` goes by the suffix."""
    lines = fmt == "jsonl" or (fmt == "auto" and re.search(r"\.(jsonl|ndjson)(\.gz|\.zst)?$", path) is not None)
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def flatten_matrix(data: dict) -> dict[str, dict[str, float]]:
    """Numeric rows at any depth; keys that open with ``_``, hold one, or are ``dialect_pairs`` are no rows; later rows win."""
    out: dict[str, dict[str, float]] = {}
    todo = [data]
    while todo:
        level = todo.pop(0)
        for key, value in level.items():
            if key.startswith("_") or key == "dialect_pairs" or not isinstance(value, dict):
                continue
            numeric = bool(value) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value.values())
            if numeric and "_" not in key:
                out[key] = {k: float(v) for k, v in value.items()}
            else:
                todo.append(value)
    return out


def matrix(path: str | Path) -> dict[str, dict[str, float]]:
    return flatten_matrix(json.loads(_text(path)))


def matrix_table(spark: SparkSession, cells: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(a, b, d) for a, row in cells.items() for b, d in row.items()], "p1 string, p2 string, d double")


def rules(folder: str | Path) -> list[dict]:
    """Rules of all YAML files of a folder, not of its subfolders, in file-name order; a repeated id is an error."""
    out, seen = [], {}
    for p in sorted(x for x in Path(folder).iterdir() if x.suffix in (".yaml", ".yml") and x.is_file()):
        listed = _yaml(p).get("rules")
        if not isinstance(listed, list):
            raise ValueError(f"{p} must hold a list of rules")
        for i, r in enumerate(listed):
            ident = r.get("id") if isinstance(r, dict) else None
            if not isinstance(ident, str) or not ident.strip():
                raise ValueError(f"{p}: rule {i} has no id")
            if ident in seen:
                raise ValueError(f"rule {ident} is in {seen[ident]} and {p}")
            seen[ident] = p
            out.append(r | {"_file": p.name, "_ordinal": i})
    return out


def rules_table(spark: SparkSession, loaded: list[dict]) -> DataFrame:
    rows = [
        (r["_file"], r["_ordinal"], r["id"], r.get("name_en"), r.get("input"), r.get("output"), r.get("context"), r.get("dialects"), bool(r.get("is_insertion")), json.dumps(r["lemma_constraints"]) if r.get("lemma_constraints") else None)
        for r in loaded
    ]
    return spark.createDataFrame(rows, RULE)


def rule_versions(folder: str | Path) -> dict[str, str]:
    """Version per file as written, ``meta.version`` before a top-level one; files without are left out."""
    out = {}
    for p in sorted(Path(folder).glob("*.y*ml")):
        m = re.search(r"^meta:\s*(?:#.*)?\n(?:[ \t]+.*\n|\s*\n)*?[ \t]+version:\s*[\"']?([\w.\-+]+)", _text(p), re.M) or re.search(r"^version:\s*[\"']?([\w.\-+]+)", _text(p), re.M)
        if m:
            out[p.name] = m.group(1)
    return out


def latest_version(versions: dict[str, str]) -> str | None:
    """The greatest version; whole parts are compared as numbers."""

    def key(v: str) -> list:
        return [int(x) if x.isdigit() else -1 for x in re.split(r"[.\-+]", v)]

    return max(versions.values(), key=key, default=None)


def catalogue(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, dialects and glossary of a reference catalogue; nested values stay JSON."""
    base = Path(folder)

    def rows(name: str, key: str, cols: list[str], lists: tuple[str, ...] = ()) -> list[tuple]:
        return [tuple(r.get(c) if c in lists else _plain(r.get(c)) for c in cols) for r in _yaml(base / name).get(key) or []]

    r = spark.createDataFrame(
        rows("grammar_rules.yaml", "rules", ["id", "buck_section", "category", "description", "transformation", "affected_dialects", "variants", "notes"], ("affected_dialects",)),
        "id string, buck_section string, category string, description string, transformation string, affected_dialects array<string>, variants string, notes string",
    )
    d = spark.createDataFrame(rows("dialects.yaml", "dialects", ["id", "name", "kind", "group", "parent", "rules"], ("rules",)), "id string, name string, kind string, dialect_group string, parent string, rules array<string>")
    g = spark.createDataFrame(
        rows("glossary.yaml", "entries", ["word", "standard_form", "dialect", "rule_id", "definition", "inscription_no", "buck_ref"]),
        "word string, standard_form string, dialect string, rule_id string, definition string, inscription_no string, buck_ref string",
    )
    return r, d, g


def _plain(v: object) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def reject_keys(value: object, forbidden: frozenset[str], at: str = "$") -> None:
    """Raise if a forbidden key stands anywhere in the document."""
    if isinstance(value, dict):
        if hit := sorted(set(value) & forbidden):
            raise ValueError(f"{at} holds {', '.join(hit)}")
        for k, v in value.items():
            reject_keys(v, forbidden, f"{at}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            reject_keys(v, forbidden, f"{at}[{i}]")


#: Keys a source list must not hold, as it cites texts but never carries them.
SOURCE_TEXT_KEYS = frozenset({"text", "full_text", "passage", "passage_text", "quote", "snippet", "content"})


def source_references(spark: SparkSession, path: str | Path) -> DataFrame:
    """(entry_id, refs): cited sources per entry; texts in the document are refused, repeated ids too."""
    doc = _yaml(path)
    reject_keys(doc, SOURCE_TEXT_KEYS)
    fields = ["source_id", "corpus", "short_citation", "external_url", "license_note", "access_policy", "citation_ready"]
    rows, seen = [], set()
    for ident, refs in (doc.get("entries") or {}).items():
        if ident.strip() in seen:
            raise ValueError(f"entry {ident.strip()!r} occurs twice")
        seen.add(ident.strip())
        rows.append((ident.strip(), [tuple(r.get(f) for f in fields) for r in refs]))
    ref = ",".join(f"{f}:{'boolean' if f == 'citation_ready' else 'string'}" for f in fields)
    return spark.createDataFrame(rows, f"entry_id string, refs array<struct<{ref}>>")


def listed(path: str | Path, key: str) -> list[dict]:
    """The objects of one list of a YAML or JSON document: a single object, a list, or under ``key``."""
    import yaml

    loaded = yaml.safe_load(_text(path))
    got = loaded.get(key, [loaded]) if isinstance(loaded, dict) else loaded
    if not isinstance(got, list) or not all(isinstance(x, dict) for x in got):
        raise ValueError(f"{path} must hold a list of objects")
    return got


def hard_cases(spark: SparkSession, path: str | Path) -> DataFrame:
    """(case_id, input_form, max_candidates, visibility, note, headword, acceptable) of a single case, a list or ``cases``.

    One row for each form that counts for an expected headword; a headword counts for itself.
    """
    rows = []
    for c in listed(path, "cases"):
        head = (c.get("case_id"), c.get("input_form"), c.get("max_candidates"), c.get("visibility"), c.get("note"))
        for e in c.get("expected") or [{}]:
            for form in dict.fromkeys([e.get("headword"), *(e.get("acceptable") or [])]):
                rows.append((*head, e.get("headword"), form))
    return spark.createDataFrame(rows, "case_id string, input_form string, max_candidates int, visibility string, note string, headword string, acceptable string")


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query): trimmed lines without blanks and # comments."""
    q = spark.read.text(path).select(F.trim("value").alias("query"))
    return q.where((F.col("query") != "") & ~F.col("query").startswith("#"))


def key_value_counts(spark: SparkSession, path: str) -> DataFrame:
    """(key, count) of a JSON object of counts."""
    got = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    return got.select(F.explode("m").alias("key", "count"))


def sentences_from_lines(lines: DataFrame, boundary: str, token: str, file: str = "file", at: str = "n") -> DataFrame:
    """(file, sentence, tokens): tokens matched line by line, a new sentence at each boundary line.

    ``lines`` has file, n (line number) and value.  Boundaries are counted by blocks of lines
    first and within a block after, so that no file is one task's.
    """
    from pyspark.sql import Window

    rows = lines.select(file, at, F.floor(F.col(at) / LINE_BLOCK).alias("_b"), F.coalesce(F.col("value").rlike(boundary), F.lit(False)).cast("int").alias("_new"), F.regexp_extract("value", token, 1).alias("_t"))
    blocks = rows.groupBy(file, "_b").agg(F.sum("_new").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(blocks.select(file, "_b", earlier.alias("_before")), [file, "_b"])
    marked = rows.withColumn("sentence", F.col("_before") + F.sum("_new").over(Window.partitionBy(file, "_b").orderBy(at)))
    toks = F.transform(F.array_sort(F.collect_list(F.struct(at, "_t"))), lambda x: x["_t"])
    return marked.where("_t <> ''").groupBy(file, "sentence").agg(toks.alias("tokens"))


def without(files: DataFrame, excluded: DataFrame, key: list[str]) -> DataFrame:
    """Files that no exclusion names, by id or by (series, volume)."""
    return files.join(excluded.select(*key).distinct(), key, "left_anti")


NOTE = "original string, normalized string, candidate_headwords array<string>, romanization string, kind string, tags array<string>, confidence string, review_status string, citation_ready boolean, reviewed_at string"


def orthographic_entries(spark: SparkSession, path: str | Path) -> DataFrame:
    """Curated correspondence entries; a missing romanization is transliterated, missing headwords are the normalized form."""
    from lexiloom.functions.scalars import transliterate
    from lexiloom.functions.unicode import nfc

    names = [c.split()[0] for c in NOTE.split(", ")]
    rows = []
    for i, e in enumerate(listed(path, "entries")):
        for k in ("original", "normalized", "kind"):
            if not isinstance(e.get(k), str) or not e[k].strip():
                raise ValueError(f"{path}: entry {i} has no {k}")
        at = e.get("reviewed_at")
        rows.append(tuple(str(at) if n == "reviewed_at" and at is not None else e.get(n) for n in names))
    df = spark.createDataFrame(rows, NOTE)
    roman = F.coalesce(F.nullif(F.trim("romanization"), F.lit("")), transliterate("normalized"))
    return df.withColumns(
        {
            "original": nfc("original"), "normalized": nfc("normalized"), "romanization": roman, "reviewed_at": F.to_timestamp("reviewed_at"),
            "candidate_headwords": F.coalesce("candidate_headwords", F.array("normalized")),
        }
    )


def key_sets(path: str | Path) -> dict[str, frozenset[str]]:
    """Named sets of headwords, as the part-of-speech overrides."""
    return {k: frozenset(v) for k, v in _yaml(path).items() if isinstance(v, list)}


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, slices: int = 32) -> DataFrame:
    """A SQLite table, read in rowid slices by as many tasks; the file must lie in a folder all executors share."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"{table!r} is no table name")
    names = [c.split()[0] for c in schema.split(",")]

    def read(batches):
        import sqlite3

        import pandas as pd

        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        low, high = con.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {table}").fetchone()
        width = -(-(high - low + 1) // slices) or 1
        for b in batches:
            for s in b["id"]:
                sql = f"select {', '.join(names)} from {table} where rowid >= ? and rowid < ?"
                yield from pd.read_sql_query(sql, con, params=(int(low + s * width), int(low + (s + 1) * width)), chunksize=50_000)

    return spark.range(0, slices, 1, slices).mapInPandas(read, schema)
