"""The public entry: one object with a language's assets prepared once and a checked request model."""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import __version__, profiles
from lexiloom.operators import catalogue, notes, rules
from lexiloom.plans import search as plan
from lexiloom.session import Scratch

# Request limits.
MAX_QUERY, MAX_CANDIDATES, DEFAULT_CANDIDATES = 64, 100, 20


@dataclass(frozen=True)
class Request:
    """A checked search request: composed query of at most 64 characters, 1 to 100 candidates, a known dialect."""

    query: str
    language: str = "ancient_greek"
    dialect: str = "attic"
    max_candidates: int = DEFAULT_CANDIDATES
    response_language: str = "en"
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self) -> None:
        text = unicodedata.normalize("NFC", self.query or "").strip()
        if not text or len(text) > MAX_QUERY:
            raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
        if not 1 <= self.max_candidates <= MAX_CANDIDATES:
            raise ValueError(f"candidates are 1 to {MAX_CANDIDATES}")
        if self.dialect not in profiles.get(self.language).dialects:
            raise ValueError(f"{self.language} has no dialect {self.dialect!r}")
        object.__setattr__(self, "query", text)


class Engine:
    """Search, explain and browse over one prepared lexicon.

    The prepared lexicon is written once to the shared folder, so every search reads
    columns it needs and none recomputes tokens or k-mers.
    """

    def __init__(self, spark: SparkSession, lexicon: DataFrame, language: str = "ancient_greek", raw_rules: list[dict] | None = None, rule_version: str | None = None, entries: DataFrame | None = None, sources: DataFrame | None = None):
        self.spark, self.profile, self.rule_version, self.entries, self.sources = spark, profiles.get(language), rule_version, entries, sources
        self.rules = rules.compile_rules(raw_rules or [], self.profile.inventory, self.profile.always_contexts, vowels=frozenset(self.profile.vowels), tolerant=self.profile.phone_matcher)
        self.lexicon = Scratch(spark, "lexicon").write(plan.prepare_lexicon(lexicon, self.profile), "prepared")

    def search(self, queries: DataFrame, results: int = 5, dialect: str | None = None) -> DataFrame:
        """All queries (qid, query) at once."""
        return plan.search(queries, self.lexicon, self.profile, self.rules, results, dialect or self.profile.dialects[0])

    def run(self, request: Request) -> DataFrame:
        """One request: hits with notes, sources, summary and the response's metadata."""
        one = self.spark.createDataFrame([(0, request.query)], "qid int, query string")
        hits = self.search(one, request.max_candidates, request.dialect)
        observed = rules.observed_steps(F.col("applications"))
        summary = notes.alignment_summary(F.col("match_type") == "Exact", F.size("applied_rules"), observed, request.response_language)
        hits = hits.withColumn("summary", summary)
        hits = hits.withColumn("why", notes.why(F.col("headword"), F.col("confidence"), F.col("summary"), request.response_language))
        if self.entries is not None:
            hits = notes.orthographic_notes(hits, self.entries, request.response_language)
            hits = hits.withColumn("bucket", notes.promoted_bucket(F.col("bucket"), F.col("notes")))
        if self.sources is not None:
            hits = catalogue.enrich(hits, self.sources.select(F.col("entry_id").alias("id"), F.inline("refs")), "id", ["short_citation"], ["source_id"], "source_refs")
        return hits.withColumns({f"meta_{k}": F.lit(v) for k, v in self.metadata(request).items()})

    def metadata(self, request: Request) -> dict[str, str]:
        """Versions and ids that make a response reproducible; logs show only the query's digest."""
        digest = hashlib.sha256(request.query.encode()).hexdigest()[:12]
        return {"request_id": request.request_id, "engine_version": __version__, "ruleset_version": self.rule_version or "", "language": self.profile.name, "query_digest": digest}


def trusted(path: str | Path, allowed: list[str | Path]) -> Path:
    """The resolved path, if it lies in one of the allowed folders once links are followed."""
    real = Path(path).resolve(strict=True)
    for folder in allowed:
        if real.is_relative_to(Path(folder).resolve(strict=True)):
            return real
    raise ValueError(f"{path} lies outside the trusted folders")
