"""Search as one plan over a table of queries.

Lexicon side, computed once and worth persisting: ``prepare_lexicon`` adds tokens, skeleton,
length, lookup key and distinct k-mers; postings are an explode of the k-mers.  Query
side: seeds come from an equi-join on k-mers; queries are then tagged with the path they
take, and a path no query takes is not planned; fallbacks serve only queries without
seeds; the quadratic alignment runs on the candidate window, the rule engine once, on
the ranked rest of all modes.  Per-query caps are ``row_number`` filters, so Spark limits
each group before it shuffles.  Query tables are never forced to be broadcast: they are
written first, so the planner knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.functions.unicode import strip_pitch_marks
from lexiloom.operators import align, rules
from lexiloom.profiles import LanguageProfile
from lexiloom.session import Scratch, spread

# Window sizes and confidence floors.
K = 2
SEED_FACTOR, SEED_LEAST = 10, 25
PARTIAL_WINDOW = 100
PARTIAL_FACTOR, PARTIAL_LEAST = 4, 10
SHORT_FLOOR, PARTIAL_FLOOR = 0.65, 0.70
FALLBACK = 2000
BATCHES = 3
NEAR = 2
LOW, MEDIUM, HIGH = 0.55, 0.70, 0.80


def seed_limit(n: Column) -> Column:
    return F.greatest(F.lit(SEED_LEAST), n * SEED_FACTOR)


def partial_limit(n: Column) -> Column:
    return F.greatest(F.lit(PARTIAL_LEAST), n * PARTIAL_FACTOR)


def annotation_limit(n: Column) -> Column:
    return F.greatest(F.lit(PARTIAL_WINDOW), n * SEED_FACTOR)


# --- lexicon --------------------------------------------------------------------


def prepare_lexicon(lexicon: DataFrame, profile: LanguageProfile, k: int = K) -> DataFrame:
    """Lexicon rows (id?, headword, ipa, dialect?, ...) with everything search joins on.

    A blank id falls back to the headword; rows without headword or ipa are left out.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    ident = F.coalesce(blank(F.col("id")) if "id" in lexicon.columns else F.lit(None), blank(F.col("headword")))
    dialect = F.col("dialect") if "dialect" in lexicon.columns else F.lit(None).cast("string")
    out = lexicon.select(ident.alias("id"), blank(F.col("headword")).alias("headword"), blank(F.col("ipa")).alias("ipa"), dialect.alias("dialect"))
    out = out.where("headword is not null and ipa is not null").withColumn("tokens", profile.tokens("ipa"))
    vowels = list(profile.vowels)
    return out.withColumns(
        {
            "n_tokens": F.size("tokens"),
            "ipa_key": S.ipa_key("ipa"),
            "kmers": S.entry_kmers("tokens", k, vowels, profile.skeleton_shifts),
            "unigrams": S.entry_kmers("tokens", 1, vowels, profile.skeleton_shifts),
        }
    )


def duplicate_ids(lexicon: DataFrame) -> DataFrame:
    """Ids that occur more than once; a lexicon must have none."""
    return lexicon.groupBy("id").count().where("count > 1")


def postings(lexicon: DataFrame, column: str = "kmers") -> DataFrame:
    """(kmer, id): the inverted index as a table."""
    return lexicon.select(F.explode(column).alias("kmer"), "id")


# --- queries --------------------------------------------------------------------


def prepare_queries(queries: DataFrame, profile: LanguageProfile, dialect: str = "attic", results: int = 5, k: int = K) -> DataFrame:
    """(qid, query) with mode, tokens, skeleton k-mers and, for wildcard queries, fragment tokens.

    Fragments are converted one by one, so nothing crosses the gap.  Blank queries raise.
    """
    q = queries.withColumn("query", F.when(F.trim("query") == "", F.raise_error(F.lit("a query is blank")).cast("string")).otherwise(F.col("query")))
    q = q.withColumns({"mode": S.query_mode("query"), "_parts": S.wildcard_parts("query")})
    ipa = lambda c: profile.to_ipa(c, dialect)
    q = q.withColumns({"_left": ipa(F.coalesce("_parts.left", F.lit(""))), "_right": ipa(F.coalesce("_parts.right", F.lit(""))), "_whole": ipa(F.col("query"))})
    q = q.withColumns(
        {
            "shape": F.col("_parts.shape"),
            "left_tokens": profile.tokens("_left"),
            "right_tokens": profile.tokens("_right"),
            "q_ipa": F.when(F.col("_parts").isNull(), F.col("_whole")).otherwise(F.trim(F.concat_ws(" ", "_left", "_right"))),
        }
    )
    q = q.withColumn("q_tokens", F.when(F.col("shape").isNull(), profile.tokens("_whole")).otherwise(F.concat("left_tokens", "right_tokens")))
    skel = S.skeleton("q_tokens", list(profile.vowels))
    q = q.withColumns({"q_skeleton": skel, "q_key": S.ipa_key("q_ipa"), "q_len": F.size("q_tokens"), "n": F.lit(results)})
    return q.withColumns({"q_kmers": S.kmers("q_skeleton", k), "q_unigrams": S.kmers("q_skeleton", 1)}).drop("_parts", "_left", "_right", "_whole")


# --- candidates -----------------------------------------------------------------


def seeds(queries: DataFrame, index: DataFrame, column: str = "q_kmers") -> DataFrame:
    """(qid, id, score, pos): the query's k-mer multiplicity in each entry, best first, ties by id."""
    wanted = queries.select("qid", F.explode(column).alias("kmer")).groupBy("qid", "kmer").agg(F.count("*").alias("w"))
    scored = index.join(wanted, "kmer").groupBy("qid", "id").agg(F.sum("w").alias("score"))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


def merge_candidates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ordered lists of (qid, id, pos) as one, first-seen ids kept."""
    both = first.select("qid", "id", F.lit(0).alias("src"), "pos").unionByName(second.select("qid", "id", F.lit(1).alias("src"), "pos"))
    once = both.groupBy("qid", "id").agg(F.min(F.struct("src", "pos")).alias("at"))
    return once.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).alias("pos"))


def exact_matches(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(qid, id): entries whose lookup key is the query's."""
    return queries.select("qid", "q_key").join(lexicon.select("id", F.col("ipa_key").alias("q_key")), "q_key").select("qid", "id")


def near_length(unselected: DataFrame, most: int = NEAR) -> DataFrame:
    """(qid, id, delta, seed_pos) in round-robin order over delta 0..most as ``turn``."""
    rn = F.row_number().over(Window.partitionBy("qid", "delta").orderBy("seed_pos"))
    near = unselected.where(F.col("delta") <= most).withColumn("_rn", rn)
    return near.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy("_rn", "delta"))).drop("_rn")


def proximity(queries: DataFrame, lexicon: DataFrame, cap: int = FALLBACK) -> DataFrame:
    """(qid, id, pos): the ``cap`` entries nearest in length, then equal keys, then id.

    Lengths are few: their counts tell how far from each query's length one must look
    for ``cap`` entries, so only those lengths are joined, by equality.
    """
    sizes = lexicon.groupBy("n_tokens").agg(F.count("*").alias("have"))
    # distinct lengths of both sides: bounded by the longest word, whatever their numbers
    band = queries.select("q_len").distinct().join(sizes, F.lit(True))
    order = Window.partitionBy("q_len").orderBy(F.abs(F.col("n_tokens") - F.col("q_len")))
    band = band.withColumn("_seen", F.sum("have").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("have").over(order.rangeBetween(0, 0)))
    band = band.where(F.col("_seen") < cap).select("q_len", "n_tokens")
    rows = lexicon.select("id", "n_tokens", "ipa").join(queries.select("qid", "q_len", "q_ipa").join(band, "q_len"), "n_tokens")
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.abs(F.col("n_tokens") - F.col("q_len")), F.col("ipa") != F.col("q_ipa"), "id"))
    return rows.withColumn("pos", pos).where(F.col("pos") <= cap).select("qid", "id", "pos")


def _preselect(queries: DataFrame, pool: DataFrame, lexicon: DataFrame, window: Column) -> DataFrame:
    """Wildcard preselection: full matches, then overlaps, then the rest, each in pool order, into ``window``."""
    q = queries.select("qid", "shape", "left_tokens", "right_tokens", window.alias("_window"))
    m = pool.join(q, "qid").join(lexicon.select("id", "tokens"), "id", "left")
    m = m.withColumn("_m", S.wildcard_match(F.col("shape"), F.col("left_tokens"), F.col("right_tokens"), F.coalesce("tokens", F.array().cast("array<string>"))))
    bucket = F.when(F.col("_m.full"), 0).when(F.col("_m.overlap") > 0, 1).otherwise(2)
    grade = F.when(bucket == 1, F.struct((-F.col("_m.frag")).alias("a"), (-F.col("_m.overlap")).alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(bucket, grade, "pos"))
    return m.withColumn("_rn", rn).where(F.col("_rn") <= F.col("_window")).select("qid", "id", F.col("_rn").alias("pos"))


def candidates(queries: DataFrame, lexicon: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(qid, id, pos, path): every query's candidates by the path it takes.

    Paths: seeded, seeded_partial, unigram, unigram_partial, proximity, proximity_partial.
    """
    scratch = scratch or Scratch(queries.sparkSession, "candidates")
    found = scratch.write(seeds(queries, postings(lexicon)), "seeds")
    has_seed = found.select(F.col("qid").alias("_seeded")).distinct()
    tagged = queries.join(has_seed, F.col("qid") == F.col("_seeded"), "left").withColumn("bare", F.col("_seeded").isNull()).drop("_seeded")
    tagged, special = scratch.write_counted(tagged, "tagged", "bare or shape is not null")
    out = _seeded(tagged.where("shape is null and not bare"), found, lexicon)
    if special:
        # single-phone seeds are many: only queries that need them look for them
        few = tagged.where("bare or shape is not null")
        found1 = scratch.write(seeds(few, postings(lexicon, "unigrams"), "q_unigrams"), "seeds1")
        for part in (_seeded_partial(tagged.where("shape is not null and not bare"), found, found1, lexicon), *_bare(tagged.where("bare"), found1, lexicon)):
            out = out.unionByName(part)
    return out


def _seeded(whole: DataFrame, found: DataFrame, lexicon: DataFrame) -> DataFrame:
    """No wildcard: top seeds, exact keys first where missing, wider by near lengths for full forms."""
    limit = whole.select("qid", "mode", "q_len", seed_limit(F.col("n")).alias("_l"))
    ranked = found.join(limit, "qid")
    top = ranked.where("pos <= _l").select("qid", "id", "pos")
    exact = exact_matches(whole, lexicon)
    added = exact.join(top.select("qid", "id"), ["qid", "id"], "left_anti")
    added = added.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    seeded = merge_candidates(added, top).join(limit.select("qid", "_l"), "qid").where("pos <= _l").select("qid", "id", "pos")
    rest = ranked.where("mode = 'Full-form'").join(exact.select("qid").distinct(), "qid", "left_anti").where("pos > _l")
    rest = rest.join(lexicon.select("id", "n_tokens"), "id").select("qid", "id", F.abs(F.col("n_tokens") - F.col("q_len")).alias("delta"), F.col("pos").alias("seed_pos"), "_l")
    wide = near_length(rest).where(F.col("turn") <= F.col("_l")).select("qid", "id", (F.col("_l") + F.col("turn")).alias("pos"))
    return seeded.unionByName(wide).withColumn("path", F.lit("seeded"))


def _seeded_partial(partial: DataFrame, found: DataFrame, found1: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Wildcard queries with seeds: seeds, then single-phone seeds, preselected by fragment matches."""
    own = partial.select("qid")
    pool = merge_candidates(found.join(own, "qid", "left_semi"), found1.join(own, "qid", "left_semi"))
    pool = pool.join(partial.select("qid", annotation_limit(F.col("n")).alias("_l")), "qid").where("pos <= _l").select("qid", "id", "pos")
    return _preselect(partial, pool, lexicon, F.greatest(seed_limit(F.col("n")), F.lit(PARTIAL_WINDOW))).withColumn("path", F.lit("seeded_partial"))


def unigram_candidates(bare: DataFrame, found1: DataFrame, lexicon: DataFrame, cap: int = FALLBACK) -> DataFrame:
    """(qid, id, pos): the ``cap`` entries that share a phone, nearest in length, then equal keys, then id."""
    hit = found1.join(bare.select("qid", "q_len", "q_ipa"), "qid").join(lexicon.select("id", "n_tokens", "ipa"), "id")
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(F.abs(F.col("n_tokens") - F.col("q_len")), F.col("ipa") != F.col("q_ipa"), "id"))
    return hit.select("qid", "id", pos.alias("pos")).where(F.col("pos") <= cap)


def _bare(bare: DataFrame, found1: DataFrame, lexicon: DataFrame) -> list[DataFrame]:
    """Queries without seeds: single-phone seeds by proximity, without those the whole lexicon by proximity."""
    uni = unigram_candidates(bare, found1, lexicon)
    prox = proximity(bare.join(found1.select("qid").distinct(), "qid", "left_anti"), lexicon)
    window = F.least(partial_limit(F.col("n")), F.lit(FALLBACK))
    whole, partial = bare.where("shape is null"), bare.where("shape is not null")
    parts = []
    for rows, path in ((uni, "unigram"), (prox, "proximity")):
        parts.append(rows.join(whole.select("qid"), "qid", "left_semi").withColumn("path", F.lit(path)))
        part = _preselect(partial, rows.join(partial.select("qid"), "qid", "left_semi"), lexicon, window)
        parts.append(part.withColumn("path", F.lit(path + "_partial")))
    return parts


# --- scoring and ranking --------------------------------------------------------


def score(cands: DataFrame, queries: DataFrame, lexicon: DataFrame, profile: LanguageProfile) -> DataFrame:
    """Candidates with lemma fields, alignment and confidence; ids the lexicon lacks are left out."""
    sw = align.local_alignment_udf(profile.matrix, list(profile.inventory))
    rows = cands.join(lexicon.select("id", "headword", "ipa", "dialect", "tokens", "n_tokens"), "id").join(
        queries.select("qid", "query", "mode", "shape", "left_tokens", "right_tokens", "q_ipa", "q_tokens", "q_len", "n"), "qid"
    )
    rows = spread(rows).withColumn("_sw", sw("q_tokens", "tokens"))
    return rows.withColumns({"confidence": align.confidence(F.col("_sw.score"), F.col("q_tokens"), F.col("tokens")), "alignment": F.col("_sw.alignment")}).drop("_sw")


def _order(*keys: Column) -> Window:
    return Window.partitionBy("qid").orderBy(*keys)


def first_by_headword(rows: DataFrame, *order: Column) -> DataFrame:
    """The first row of each query and headword in the given order."""
    rn = F.row_number().over(Window.partitionBy("qid", "headword").orderBy(*order))
    return rows.withColumn("_first", rn).where("_first = 1").drop("_first")


def annotate(rows: DataFrame, ruleset: rules.RuleSet) -> DataFrame:
    """Applications, applied rule ids, drawing and dialect attribution of each row."""
    run = rules.explain_udf(ruleset)
    out = rows.withColumn("applications", run("alignment", F.struct("id", "headword", "ipa", "dialect")))
    out = out.withColumn("applied_rules", rules.applied_rules(F.col("applications")))
    out = out.withColumn("_marks", rules.markers(F.col("alignment"), F.col("applications")))
    return out.withColumns(
        {"drawing": rules.visualization(F.col("alignment"), F.col("_marks")), "dialect_attribution": rules.dialect_attribution(F.col("dialect"), F.col("applications"))}
    ).drop("_marks")


def finalize(scored: DataFrame, ruleset: rules.RuleSet) -> DataFrame:
    """The results of each query by its mode, ranked from 1.

    One chain of windows for all modes, whose sort keys depend on the mode; the rule
    engine sees only what their first ranking leaves.
    """
    conf, lemma = F.desc("confidence"), F.asc_nulls_last("headword")
    full, short, part = (F.col("mode") == m for m in ("Full-form", "Short-query", "Partial-form"))
    by_mode = lambda a, b: F.when(short, a).when(part, b)
    scored = scored.withColumns(
        {
            "rank0": F.row_number().over(_order(conf, lemma, F.col("pos"), F.col("id"))),
            "exact": F.col("q_tokens") == F.col("tokens"),
            "delta": F.abs(F.col("n_tokens") - F.col("q_len")),
            "_m": F.when(part, S.wildcard_match(F.col("shape"), F.col("left_tokens"), F.col("right_tokens"), F.col("tokens"))),
        }
    )
    # a full form's entries are made distinct before they are ranked, the others' after
    scored = scored.withColumn("_first", F.row_number().over(Window.partitionBy("qid", "headword").orderBy("rank0"))).where(~full | (F.col("_first") == 1))
    primary = F.col("exact") | (F.col("confidence") >= SHORT_FLOOR)
    good = F.col("confidence") >= PARTIAL_FLOOR
    overlap, frag, whole = F.col("_m.overlap"), F.col("_m.frag"), F.col("_m.full")
    context = F.abs(F.col("n_tokens") - F.size("left_tokens") - F.size("right_tokens"))
    keys = (
        by_mode(~primary, ~((overlap > 0) | whole | good)),
        by_mode(~(F.col("exact") & primary), ~whole),
        by_mode(F.when(primary, (F.col("confidence") < SHORT_FLOOR).cast("int")), -frag),
        by_mode(F.lit(0), -overlap),
        by_mode(F.lit(False), ~good),
        by_mode(F.col("delta"), context),
    )
    wide = annotation_limit(F.col("n"))
    ranked = scored.withColumn("_w", F.row_number().over(_order(*keys, conf, lemma, F.col("rank0"))))
    ranked = ranked.where(F.col("_w") <= F.when(full, F.col("n")).when(short, wide * BATCHES).otherwise(wide))

    out = annotate(spread(ranked), ruleset)
    ruled = F.size("applied_rules") > 0
    out = out.where(full | (short & (primary | ruled)) | (part & (whole | ((overlap > 0) & (ruled | good)))))
    keys = (
        by_mode(F.floor((F.col("_w") - 1) / wide), F.lit(0)),
        by_mode(~F.col("exact"), ~whole),
        by_mode(-F.col("confidence"), -frag.cast("double")),
        by_mode(~ruled, F.lit(False)),
        by_mode(F.lit(0), -overlap),
        by_mode(F.lit(False), ~ruled),
        by_mode(F.lit(0.0), -F.col("confidence")),
        F.when(~full, F.coalesce("headword", F.when(part, F.lit("")), F.lit("\U0010ffff"))),
        F.col("_w"),
    )
    out = first_by_headword(out, *keys).withColumn("rank", F.row_number().over(_order(*keys))).where(F.col("rank") <= F.col("n"))
    return out.drop("_m", "_w", "_first")


def classify(results: DataFrame) -> DataFrame:
    """Match type, uncertainty, bucket and distance of each result."""
    same = strip_pitch_marks(F.trim("ipa")) == strip_pitch_marks(F.trim("q_ipa"))
    out = results.withColumns({"_same": same, "_rules": F.size("applied_rules")})
    out = out.withColumn("match_type", match_type(F.col("_same") & (F.size("applications") == 0), F.col("_rules"), F.col("confidence")))
    out = out.withColumn("uncertainty", uncertainty(F.col("match_type"), F.col("_rules"), F.col("confidence")))
    return out.withColumns({"bucket": bucket(F.col("match_type"), F.col("mode"), F.col("uncertainty")), "distance": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("confidence")))}).drop("_same", "_rules")


def match_type(exact: Column, n_rules: Column, conf: Column) -> Column:
    return F.when(exact, "Exact").when(n_rules > 0, "Rule-based").when(conf < LOW, "Low-confidence").otherwise("Distance-only")


def uncertainty(kind: Column, n_rules: Column, conf: Column) -> Column:
    return F.when((kind == "Exact") | ((n_rules > 0) & (conf >= HIGH)), "Low").when(conf >= MEDIUM, "Medium").otherwise("High")


def bucket(kind: Column, mode: Column, unsure: Column) -> Column:
    named = kind.isin("Exact", "Rule-based")
    return F.when(named | ((mode == "Full-form") & (unsure == "Low")), "Supported").otherwise("Exploratory")


def search(queries: DataFrame, lexicon: DataFrame, profile: LanguageProfile, ruleset: rules.RuleSet | None = None, results: int = 5, dialect: str = "attic") -> DataFrame:
    """Rank the headwords that could have given each query (qid, query), and explain them.

    ``lexicon`` comes from ``prepare_lexicon``.
    """
    if results <= 0:
        raise ValueError("results must be positive")
    # written once, as several branches of the plan read each: conversion, seeding and alignment run once
    scratch = Scratch(queries.sparkSession, "search")
    q = scratch.write(prepare_queries(queries, profile, dialect, results), "queries")
    lexicon = scratch.write(lexicon, "lexicon")
    scored = scratch.write(score(candidates(q, lexicon, scratch), q, lexicon, profile), "scored")
    out = classify(finalize(scored, ruleset or rules.RuleSet([])))
    return out.select(
        "qid", "query", "mode", "path", "rank", "id", "headword", "ipa", "confidence", "distance", "match_type", "uncertainty", "bucket",
        "applied_rules", "applications", "drawing", "dialect_attribution", "alignment",
    )
