"""Sinks: record files, resumable extraction, run summaries, single documents, fingerprints.

Spark's committer makes writes atomic; a resumed run anti-joins what its manifest holds.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file, for results that one file is to hold; written beside it and renamed when whole."""
    import os

    part = f"{path}.tmp"
    try:
        with open(part, "w", encoding="utf-8") as out:
            out.write("[")
            for k, (row,) in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()):
                out.write(("," if k else "") + "\n" + row)
            out.write("\n]\n")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def pending(files: DataFrame, manifest: DataFrame, key: str = "source_file") -> DataFrame:
    """Files no earlier run has finished."""
    return files.join(manifest.select(key).distinct(), key, "left_anti")


def with_run_summary(records: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """``records`` observed while they are written: pairs, and pairs without a papyrus number."""
    seen = Observation(name)
    return records.observe(seen, F.count("*").alias("pairs"), F.count(F.when(F.col("tm_id").isNull(), 1)).alias("missing_tm")), seen


def matrix_document(scores: DataFrame, meta: dict) -> str:
    """A learned matrix as one JSON document; scores are (a, b, score), a bounded alphabet's triangle."""
    rows: dict[str, dict[str, float]] = {}
    for r in scores.select("a", "b", "score").toLocalIterator():
        rows.setdefault(r["a"], {})[r["b"]] = r["score"]
        rows.setdefault(r["b"], {})[r["a"]] = r["score"]
    stamp = datetime.now(UTC).isoformat(timespec="milliseconds")
    return json.dumps({"_meta": {"generated_at": stamp, "alphabet": sorted(rows)} | meta, "scores": {k: dict(sorted(v.items())) for k, v in sorted(rows.items())}}, ensure_ascii=False, indent=1)


def lexicon_summary(lexicon: DataFrame) -> DataFrame:
    """Counts by part of speech; a lexicon of more than one dialect raises."""
    one = lexicon.agg(F.when(F.countDistinct("dialect") > 1, F.raise_error(F.lit("a lexicon document has one dialect")).cast("string")).otherwise(F.first("dialect")).alias("dialect"))
    return lexicon.groupBy("pos").agg(F.count("*").alias("n")).join(F.broadcast(one))


def lexicon_document(lexicon: DataFrame, path: str, version: str = "2.0.0", sources: list[dict] | None = None) -> dict:
    """The lexicon as a folder of JSON lines with its ``_meta``: version, dialect, counts, sources; the meta is returned."""
    counts = lexicon_summary(lexicon).collect()  # as many rows as parts of speech
    lexicon.write.mode("overwrite").json(f"{path}/lemmas")
    dialect = counts[0]["dialect"] if counts else None
    meta = {"schema_version": version, "dialect": dialect, "entries": sum(r["n"] for r in counts), "pos_counts": {r["pos"]: r["n"] for r in sorted(counts, key=lambda r: str(r["pos"]))}, "supplemental_sources": sources or []}
    lexicon.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")
    return meta


def build_lexicon(spark, xml_path: str, path: str, supplement: DataFrame | None = None, skip_if_present: bool = False, **sets) -> bool:
    """Dictionary files to a checked lexicon document; false if it is there and may be skipped."""
    from lexiloom.operators import catalogue, validation
    from lexiloom.sources import dictionary, xml

    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_meta/_SUCCESS")
    if skip_if_present and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    entries = dictionary.entries(xml.files(spark, xml_path), **sets)
    if supplement is not None:
        entries = catalogue.merge_lexicons(entries, supplement)
    validation.assert_valid(validation.lexicon(entries))
    lexicon_document(entries, path)
    return True


def identities(files: DataFrame) -> DataFrame:
    """(name, bytes, sha256) of each of (source_file, content): what a result was made from."""
    return files.select(F.regexp_extract("source_file", "([^/]+)$", 1).alias("name"), F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def candidate_lists(cands: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per token with its ranked candidates as an array of structs."""
    return cands.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("cands"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One SHA-256 over paths, sizes and contents of (source_file, content), whatever their order in partitions.

    Contents are hashed where they lie; digests are ordered and hashed in 4,096 parts, then the parts.
    """
    one = F.sha2(F.concat_ws("|", F.length("source_file").cast("string"), "source_file", F.octet_length("content").cast("string"), F.sha2("content", 256)), 256)
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = files.select(one.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.concat("part", joined("h")).alias("h"), F.count("*").alias("n"))
    return parts.agg(joined("h").alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
