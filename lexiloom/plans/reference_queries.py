"""Queries of the phonological search, learning, catalogue and evaluation operators.

The ASCII profile's lexicon is the distinct lower-case words of all documents; the Greek
profile's is the list of word forms.  ``ORACLE_SQL`` states the same in DuckDB's SQL
where SQL can; alignment kernels, rule matching and resampling have none and are tested
against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import profiles
from lexiloom.functions import scalars as S
from lexiloom.functions.unicode import nfc
from lexiloom.operators import align, catalogue, evaluation, fuzzy, hierarchy, labels, ladder, learn, ngrams, ordered, rules, seeds
from lexiloom.plans import search as P
from lexiloom.plans.data_queries import _LATEST, table
from lexiloom.session import Scratch, spread

#: Misspelt query words of the ASCII profile.
QUERY_WORDS = (
    "papirus", "legder", "villige", "witnes", "barlee", "contrakt", "scribb", "kanal", "ostrakon", "marginn",
    "ledger", "priest", "grannary", "measurs", "folded", "sylver", "oat", "io", "tea", "eye",
)
VOWELS = tuple("aeiou")


def query_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in QUERY_WORDS], "query string")


def _words(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """(word, freq): distinct lower-case ASCII words of all documents."""
    return _words(table(spark, d, "documents")).groupBy("word").agg(F.count("*").alias("freq"))


def row_words(spark: SparkSession, d: str) -> DataFrame:
    """The queries of searches: distinct words of every document whose id is divisible by 20."""
    return _words(table(spark, d, "documents").where("doc_id % 20 = 0")).select(F.col("word").alias("query")).distinct()


def all_words(spark: SparkSession, d: str) -> DataFrame:
    """The left side of joins: the whole lexicon."""
    return lexicon(spark, d).select(F.col("word").alias("query"))


def _joined(tokens: Column | str) -> Column:
    return F.array_join(tokens, " ")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d).withColumn("tok", S.digraph_tokens("word"))


def _skeletons(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).withColumn("sk", S.skeleton("tok", list(VOWELS)))


# --- scalars and indexes --------------------------------------------------------


def lexicon_tokens(spark, d):
    return _tokens(spark, d).select("word", "freq", _joined("tok").alias("tokens"), F.size("tok").cast("bigint").alias("n_tokens"))


def consonant_skeleton(spark, d):
    return _skeletons(spark, d).select("word", _joined("sk").alias("skeleton"))


def _postings(spark, d, k: int = 2):
    return _skeletons(spark, d).select("word", F.explode(F.array_distinct(S.kmers("sk", k))).alias("kmer"))


def kmer_postings(spark, d):
    return _postings(spark, d).select("kmer", "word")


def _query_tokens(spark, d, words):
    q = words(spark, d).withColumn("tok", S.digraph_tokens("query"))
    q = q.withColumn("sk", S.skeleton("tok", list(VOWELS)))
    return q.select(F.col("query").alias("qid"), F.size("tok").alias("q_len"), F.col("query").alias("q_ipa"), S.kmers("sk", 2).alias("q_kmers"), S.kmers("sk", 1).alias("q_unigrams"))


def _seeds(spark, d, words):
    return P.seeds(_query_tokens(spark, d, words), _postings(spark, d).select("kmer", F.col("word").alias("id")))


def _best_seeds(spark, d, words, near: int = 0, each: int = 0):
    """The 25 best seeds of each query, and with ``each`` those that may follow them by length."""
    q = _query_tokens(spark, d, words).select("qid", F.col("q_kmers").alias("kmers"), F.col("q_len").alias("n"))
    return seeds.best_seeds(q, _skeletons(spark, d).select(F.col("word").alias("id"), F.array_distinct(S.kmers("sk", 2)).alias("kmers"), F.size("tok").alias("n")), 25, near, each)


def seed_topk(spark, d, words=query_words):
    got = _best_seeds(spark, d, words).where("pos <= 25")
    return got.select(F.col("qid").alias("query"), F.col("id").alias("word"), "score", F.col("pos").cast("bigint").alias("rank"))


def unigram_fallback(spark, d, words=query_words):
    """Queries without k=2 seeds, served by single consonants, nearest in length first."""
    q = _query_tokens(spark, d, words)
    bare = q.join(_seeds(spark, d, words).select("qid").distinct(), "qid", "left_anti")
    index = _postings(spark, d, 1).select("kmer", F.col("word").alias("id"))
    lex = _tokens(spark, d).select(F.col("word").alias("id"), F.size("tok").alias("n_tokens"), F.col("word").alias("ipa"))
    got = P.unigram_candidates(bare, P.seeds(bare, index, "q_unigrams"), lex, 20)
    return got.select(F.col("qid").alias("query"), F.col("id").alias("word"), F.col("pos").cast("bigint").alias("rank"))


def proximity_topk(spark, d, words=query_words):
    lex = _tokens(spark, d).select(F.col("word").alias("id"), F.size("tok").alias("n_tokens"), F.col("word").alias("ipa"))
    got = P.proximity(_query_tokens(spark, d, words), lex, 20)
    return got.select(F.col("qid").alias("query"), F.col("id").alias("word"), F.col("pos").cast("bigint").alias("rank"))


def length_band_round_robin(spark, d, words=query_words):
    rest = _best_seeds(spark, d, words, P.NEAR, 25).where("pos > 25")
    near = P.near_length(rest.select("qid", "id", "delta", F.col("pos").alias("seed_pos")))
    return near.where("turn <= 25").select(F.col("qid").alias("query"), F.col("id").alias("word"), F.col("delta").cast("bigint").alias("delta"), F.col("turn").cast("bigint").alias("turn"))


def headword_dedup(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("headword"), "p_partkey", "p_retailprice", F.lit(1).alias("qid"))
    return P.first_by_headword(p, F.desc("p_retailprice"), F.col("p_partkey")).select("headword", "p_partkey", "p_retailprice")


# --- fuzzy joins and ladder -----------------------------------------------------


def _fuzzy(k: int):
    def query(spark, d, words=query_words):
        # written once, as the join reads each side twice
        lex = spread(Scratch(spark, "fuzzy").write(lexicon(spark, d).select("word"), "words"))
        left = lex.select(F.col("word").alias("query")) if words is all_words else words(spark, d)
        return fuzzy.edit_distance_join(left, lex, "query", "word", k).select("query", "word", F.col("dist").cast("bigint").alias("dist"))

    return query


def unit_normalized_distance(spark, d, words=query_words):
    """The native weighted distance with no matrix over letters is the unit distance over the longer length."""
    pairs = _fuzzy(2)(spark, d, words)
    dist = align.normalised_distance(F.split("query", ""), F.split("word", ""), {})
    return pairs.select("query", "word", F.round(dist, 6).alias("distance"))


def _full(rows: DataFrame, match: Column) -> DataFrame:
    """Full matches; generated from an array, so that the match is computed once a row."""
    got = rows.select("query", "word", F.inline(F.filter(F.array(match), lambda m: m["full"])))
    return got.select("query", "word", F.col("frag").cast("bigint").alias("fragments"), F.col("overlap").cast("bigint").alias("overlap"))


def _wild(pattern: str):
    def query(spark, d):
        p = S.wildcard_parts("query")
        one = spark.createDataFrame([(pattern,)], "query string").select(p["shape"].alias("shape"), S.digraph_tokens(p["left"]).alias("l"), S.digraph_tokens(p["right"]).alias("r")).first()
        tokens = lambda side: F.array(*map(F.lit, one[side])).cast("array<string>")
        match = S.wildcard_match(F.lit(one["shape"]), tokens("l"), tokens("r"), F.col("tok"))
        return _full(_tokens(spark, d).withColumn("query", F.lit(pattern)), match)

    return query


#: Patterns by shape, built from a query word: its first three letters, its last two, its first and its last two.
PATTERNS = {
    "prefix": "concat(left(query, 3), '-')",
    "suffix": "concat('-', right(query, 2))",
    "infix": "if(length(query) > 2, concat(left(query, 1), '-', right(query, 2)), null)",
}


def _infixes(t: DataFrame, q: DataFrame) -> DataFrame:
    """Full infix matches of one-letter left fragments: its first place comes before the right fragment's last.

    Words meet patterns by the right fragment, a run of one or two tokens; places are all that a pair
    needs, so no row carries a word's tokens and none is matched anew.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"
    t = t.select("*", S.kmers("tok", 2).alias("two"))
    t = spread(Scratch(t.sparkSession, "infixes").write(t, "tokens"))  # else the tokens would be computed again for every run
    last = lambda c: F.transform(F.array_distinct(c), lambda b: F.struct(b.alias("b"), (F.size(c) + 1 - F.array_position(F.reverse(c), b)).alias("j")))
    first = F.array(*[F.array_position("tok", F.lit(a)).cast("int") for a in letters])
    last = t.select("word", first.alias("first"), F.inline(F.concat(last("tok"), last("two"))))
    asked = F.struct(F.instr(F.lit(letters), F.element_at("l", 1)).alias("a"), "query", F.size("r").alias("n"))
    # both sides of the pattern are of the alphabet: at most 26 by 26 by 26 patterns, whatever the tables hold
    q = q.select(F.array_join("r", " ").alias("b"), asked.alias("p")).groupBy("b").agg(F.collect_list("p").alias("ps"))
    place = lambda p: F.element_at("first", p["a"])
    got = last.join(F.broadcast(q), "b").select("word", F.inline(F.filter("ps", lambda p: (place(p) > 0) & (place(p) < F.col("j")))))
    return got.select("query", "word", F.lit(2).cast("bigint").alias("fragments"), (F.col("n") + 1).cast("bigint").alias("overlap"))


def _wild_all(shape: str):
    """Patterns of all query words, joined by the tokens a full match must hold rather than word by word."""

    def query(spark, d):
        q = row_words(spark, d).select(F.expr(PATTERNS[shape]).alias("query")).where("query is not null").distinct().withColumn("p", S.wildcard_parts("query"))
        q = q.select("query", "p.shape", S.digraph_tokens("p.left").alias("l"), S.digraph_tokens("p.right").alias("r"))
        t = _tokens(spark, d).select("word", "tok")
        if shape == "infix":
            return _infixes(t, q)
        edge = F.lit(1 if shape == "prefix" else -1)
        t, q = t.withColumn("a", F.element_at("tok", edge)), q.withColumn("a", F.element_at("l" if shape == "prefix" else "r", edge))
        return _full(t.join(q, "a"), S.wildcard_match(F.col("shape"), F.col("l"), F.col("r"), F.col("tok")))

    return query


def ascii_collapse(c: Column) -> Column:
    """c, q like k; z like s; y like i; doubled letters single."""
    return F.regexp_replace(F.translate(c, "cqzy", "kksi"), r"(.)\1+", "$1")


def collapse_keys(spark, d):
    return lexicon(spark, d).select("word", ascii_collapse(F.col("word")).alias("key"))


def collapse_join(spark, d, words=query_words):
    return fuzzy.key_join(words(spark, d), lexicon(spark, d), "query", "word", ascii_collapse)


def candidate_union_mincost(spark, d, words=query_words):
    got = ladder.union(ladder.generators(words(spark, d), lexicon(spark, d), ascii_collapse))
    return got.select("query", "word", F.round("cost", 6).alias("cost"), F.col("freq").cast("bigint").alias("freq"))


def cascade_vs_union(spark, d, words=query_words):
    """Per query the candidates of the cascade's first stage that has any, beside those of the union."""
    parts = ladder.generators(words(spark, d), lexicon(spark, d), ascii_collapse)
    c = ladder.cascade(parts).groupBy("query").agg(F.first("stage").alias("stage"), F.countDistinct("word").alias("n_cascade"))
    u = ladder.union(parts).groupBy("query").agg(F.count("*").alias("n_union"))
    return u.join(c, "query").select("query", "stage", "n_cascade", "n_union")


def ladder_rank(spark, d, words=query_words):
    got = ladder.ranked(ladder.union(ladder.generators(words(spark, d), lexicon(spark, d), ascii_collapse)))
    return got.select("query", "word", F.col("rank").cast("bigint").alias("rank"))


def additive_rerank(spark, d, words=query_words):
    u = ladder.union(ladder.generators(words(spark, d), lexicon(spark, d), ascii_collapse))
    s = F.round(ladder.additive_score(F.col("freq"), F.col("freq"), F.col("cost")), 6)
    return ladder.ranked(u.withColumn("score", s), F.desc("score"), F.col("word")).select("query", "word", "score", F.col("rank").cast("bigint").alias("rank"))


# --- counts, log-odds, n-grams --------------------------------------------------


def _letter_pairs(spark, d):
    w = lexicon(spark, d).select("word")
    near = fuzzy.edit_distance_join(w.withColumnRenamed("word", "x"), w.withColumnRenamed("word", "y"), "x", "y", 1)
    near = near.where("x < y and length(x) = length(y)")
    cols = F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: F.struct(p.alias("q"), q.alias("l")))
    return near.select(cols.alias("alignment"))


def pair_counts(spark, d):
    return learn.column_counts(_letter_pairs(spark, d)).select("a", "b", F.col("n").cast("bigint").alias("n"))


def indel_free_log_odds(spark, d):
    return learn.log_odds(learn.column_counts(_letter_pairs(spark, d))).select("a", "b", "n", F.round("score", 6).alias("score"))


def learned_log_odds(spark, d):
    """Spelling pairs as phones, aligned globally, counted and scored.  Repeated pairs are aligned once and weighted."""
    pairs = table(spark, d, "choice_records").where("original is not null and regularized is not null").groupBy("original", "regularized").agg(F.count("*").alias("w"))
    toks = pairs.select("w", S.tokenize(S.to_ipa("original")).alias("q"), S.tokenize(S.to_ipa("regularized")).alias("l"))
    return learn.log_odds(learn.column_counts(learn.aligned_pairs(toks, "q", "l"), F.col("w"))).select("a", "b", "n", F.round("score", 6).alias("score"))


def _sentences(spark, d):
    parts = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[.;\n]+")).alias("s"))
    return parts.select(F.regexp_extract_all("s", F.lit("([a-z]+)"), 1).alias("tok"))


def _whole_sentences(documents: DataFrame, *keep: str) -> DataFrame:
    """As ``_sentences``, with the words of every script: letters and marks of the composed text, σ and ς being one letter."""
    parts = documents.select(*keep, F.explode(F.split(F.translate(F.lower(nfc("text")), "ς", "σ"), r"[.;\n]+")).alias("s"))
    return parts.select(*keep, F.regexp_extract_all("s", F.lit(r"([\p{L}\p{M}]+)"), 1).alias("tok"))


def _grams(n: int, whole: bool = False):
    def query(spark, d):
        return ngrams.counts(_whole_sentences(table(spark, d, "documents")) if whole else _sentences(spark, d), "tok", n)

    return query


def stupid_backoff(spark, d):
    """Scores of every trigram that ends a sentence."""
    tri = Scratch(spark, "backoff").write(ngrams.counts(_sentences(spark, d), "tok", 3), "trigrams")
    uni, bi, _ = _rolled_up(tri)
    ends = tri.where(F.col("w3") == ngrams.EOS).select("w1", "w2", "w3")
    total = uni.agg(F.sum("count").alias("total"))
    scored = ngrams.backoff(ends.join(F.broadcast(total)), uni, bi, tri, F.col("total"))
    return scored.select("w1", "w2", F.round("score", 6).alias("score"))


def _rolled_up(tri: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of words, of word pairs and of the two opening marks, from those of trigrams: the documents are read once.

    Every shorter gram but the opening marks ends one trigram.
    """
    bi = tri.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.sum("count").alias("count"))
    opening = tri.where((F.col("w1") == ngrams.BOS) & (F.col("w2") == ngrams.BOS)).groupBy("w1", "w2").agg(F.sum("count").alias("count"))
    uni = tri.groupBy(F.col("w3").alias("w1")).agg(F.sum("count").alias("count")).unionByName(opening.select("w1", (2 * F.col("count")).alias("count")))
    return uni, bi, opening


def stupid_backoff_all(spark, d):
    """Scores of every trigram of all documents; the counts leave out documents whose id is divisible by 20, so theirs back off.

    As in the reference, the two opening marks are a context too: their count is the number of sentences.
    """
    docs = table(spark, d, "documents").withColumn("counted", F.when(F.col("doc_id") % 20 == 0, 0).otherwise(1))
    s = _whole_sentences(docs, "counted").where(F.size("tok") > 0)
    seen = s.select("counted", F.inline(ngrams.ngrams("tok", 3)).alias("w1", "w2", "w3")).groupBy("w1", "w2", "w3").agg(F.sum("counted").alias("count"))
    triples = Scratch(spark, "backoff").write(seen, "seen")
    tri = triples.where("count > 0")
    uni, bi, opening = _rolled_up(tri)
    total = uni.agg(F.sum("count").alias("total"))
    scored = ngrams.backoff(triples.drop("count").join(F.broadcast(total)), uni, bi.unionByName(opening), tri, F.col("total"))
    return scored.select("w1", "w2", "w3", F.round("score", 6).alias("score"))


def context_lag2(spark, d):
    """The two events before each event of a user; a user's events may fill many partitions."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return ordered.lagged(e, "user_id", ["ts", "event_id"], "event_type", 2, ngrams.BOS).select("event_id", "prev1", "prev2")


# --- evaluation -----------------------------------------------------------------


def doc_split(spark, d):
    return evaluation.document_split(table(spark, d, "documents"), "doc_id", "n_chars")


def doc_split_stratified(spark, d):
    docs = evaluation.top_strata(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "lang", "n_chars", 4)
    return evaluation.document_split(docs, "doc_id", "n_chars", stratum="lang")


def doc_split_stratified_all(spark, d):
    """Split by language, whose case and blanks do not count."""
    lang = F.nullif(F.lower(F.trim("lang")), F.lit(""))
    docs = evaluation.top_strata(table(spark, d, "documents").select("doc_id", "n_chars", lang.alias("lang")), "lang", "n_chars")
    return evaluation.document_split(docs, "doc_id", "n_chars", stratum="lang")


def _ranks(spark, d):
    """Rank of each entry's normalized form among its candidates; null if it is none of them."""
    c = table(spark, d, "correspondence_entries")
    rank = F.nullif(F.array_position("candidate_headwords", F.col("normalized")), F.lit(0)) - 1
    return c.select("entry_id", F.col("review_status").alias("split"), F.col("kind").alias("doc"), rank.cast("bigint").alias("rank"), F.size("candidate_headwords").cast("bigint").alias("n_cand"), "confidence")


def recall_at_k(spark, d):
    return evaluation.recall(_ranks(spark, d))


def rank_profile(spark, d):
    got = evaluation.rank_profile(_ranks(spark, d))
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def rank_percentiles(spark, d):
    return evaluation.exact_index_percentile(_ranks(spark, d), "n_cand", [0.5, 0.9, 1.0])


def _hits(spark, d):
    r = table(spark, d, "results_lm_paired").where("n_tokens > 0")
    half = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n_tokens") >= 0.5
    return r.select("source_file", half("hits_a").alias("a"), half("hits_b").alias("b"))


def discordant_counts(spark, d):
    return evaluation.discordant(_hits(spark, d), "a", "b")


def mcnemar(spark, d):
    got = evaluation.discordant(_hits(spark, d), "a", "b")
    return got.withColumn("p_value", F.round(evaluation.mcnemar_p("only_a", "only_b"), 9))


def cluster_bootstrap(spark, d):
    return evaluation.cluster_bootstrap(_hits(spark, d), "source_file", "a", "b")


def facet_three_valued(spark, d):
    """Entries kept by two facets, unknown values kept (conservative) or dropped (aggressive)."""
    rows = _ranks(spark, d)
    facets = [F.col("confidence") != "low", F.when(F.col("n_cand") > 0, F.col("n_cand") <= 2)]
    out = None
    for policy, keep in (("conservative", True), ("aggressive", False)):
        kept = evaluation.apply_facets(rows, facets, keep)
        agg = kept.agg(F.count("*").alias("kept"), F.count("rank").alias("gold_kept")).select(F.lit(policy).alias("policy"), "kept", "gold_kept")
        out = agg if out is None else out.unionByName(agg)
    return out


def failure_buckets(spark, d):
    r = _ranks(spark, d)
    b = evaluation.failure_bucket(F.coalesce(F.col("rank") < 1, F.lit(False)), F.col("n_cand") > 0, F.col("rank").isNotNull())
    return r.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p)), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0))])


def ols_fit(spark, d):
    got = evaluation.ols(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return got.select(*[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2", "mean_x", "sxx")], "n")


def match_type_buckets(spark, d):
    """Hit classes over the evaluated files: share of hits as confidence, hits of the second system as rules."""
    r = table(spark, d, "results_lm_paired").where("n_tokens > 0")
    conf, n_rules = F.col("hits_a") / F.col("n_tokens"), F.when(F.col("hits_b") > F.col("hits_a"), 1).otherwise(0)
    r = r.select(conf.alias("c"), n_rules.alias("r")).withColumn("match_type", P.match_type(F.col("c") >= 1, F.col("r"), F.col("c")))
    r = r.withColumn("uncertainty", P.uncertainty(F.col("match_type"), F.col("r"), F.col("c")))
    r = r.withColumn("bucket", P.bucket(F.col("match_type"), F.lit("Full-form"), F.col("uncertainty")))
    return r.groupBy("match_type", "uncertainty", "bucket").agg(F.count("*").alias("n"))


# --- catalogue ------------------------------------------------------------------


def hierarchy_rules(spark, d):
    """Rules of every dialect, its own and inherited ones, at their smallest distance."""
    src = table(spark, d, "buck_dialects")
    _, nodes, rings = hierarchy.hierarchy(src)
    latest = src.select(F.lower(F.trim("id")).alias("dialect"), "rules", F.struct("loaded_at", "row_id").alias("at")).where("dialect <> ''").groupBy("dialect").agg(F.max_by("rules", "at").alias("rules"))
    own = latest.select("dialect", F.explode("rules").alias("rule")).distinct()
    got = catalogue.inherited(hierarchy.ancestor_pairs(nodes, rings), own, "dialect", "rule")
    return got.select("dialect", "rule", F.col("depth").cast("bigint").alias("depth"))


def catalog_filter_page(spark, d):
    rows = catalogue.matching(table(spark, d, "part"), {"p_brand": "Brand#13", "p_size": None})
    return catalogue.page(rows.select("p_partkey", "p_name", "p_brand"), ["p_name", "p_partkey"], limit=20, offset=10)


def catalog_foreign_keys(spark, d):
    """Glossary entries whose rule is in no rule row, or whose dialect in no dialect row."""
    entries = table(spark, d, "buck_glossary").withColumn("dialect", F.lower(F.trim("dialect")))
    known = table(spark, d, "buck_dialects").select(F.lower(F.trim("id")).alias("id"))
    no_rule = catalogue.missing_keys(entries, "rule_id", table(spark, d, "buck_rules"), "id").select("entry_id", F.lit("rule_id").alias("key"), F.col("rule_id").alias("value"))
    return no_rule.unionByName(catalogue.missing_keys(entries, "dialect", known, "id").select("entry_id", F.lit("dialect").alias("key"), F.col("dialect").alias("value")))


def left_enrich_array(spark, d):
    """Orders with the lines of each as one list, empty for none."""
    got = catalogue.enrich(
        table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_partkey"], ["l_linenumber", "l_partkey"]
    )
    return got.select("o_orderkey", F.array_join(F.transform("refs", lambda r: r["l_linenumber"].cast("string")), ",").alias("line_numbers"), F.size("refs").cast("bigint").alias("n_lines"))


def drop_reasons(spark, d):
    t = F.col("text")
    reasons = catalogue.drop_reasons(
        short=F.col("n_chars") < 200, long=F.col("n_chars") > 10_000, no_lang=F.col("lang").isNull(), no_source=F.col("source").isNull(), no_words=~t.rlike("[a-z]{3}")
    )
    return table(spark, d, "documents").select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# --- Greek profile and kernels --------------------------------------------------


def form_keys(spark, d):
    """Every word form's phones, skeleton, transliteration and keys."""
    f = table(spark, d, "word_forms")
    phones = S.tokenize(S.to_ipa("form"))
    return f.select(
        "form_id", "form", _joined(phones).alias("phones"), _joined(S.skeleton(phones)).alias("skeleton"), _joined(S.tokenize(S.to_ipa("form", "koine"))).alias("koine"),
        S.transliterate("form").alias("latin"), S.base_key("form").alias("base_key"), S.collapse_key("form").alias("collapse_key"), F.array_join(S.query_variants("form"), " ").alias("variants"),
    )


def markup_classes(spark, d):
    """Spelling pairs by what is left once editorial marks are gone."""
    c = table(spark, d, "choice_records").where("regularized is not null")
    return c.groupBy(S.markup_class("original", "regularized").alias("class"), (F.size(S.residue(S.clean_markup("original"))) > 0).alias("has_residue")).agg(F.count("*").alias("n"))


def sw_search(spark, d):
    """Every variant form searched among the standard forms: ranked, classified and explained."""
    forms = table(spark, d, "word_forms")
    lex = forms.where("kind = 'standard'").select(F.col("form_id").cast("string").alias("id"), F.col("form").alias("headword"), S.to_ipa("form").alias("ipa"), F.lit("attic").alias("dialect"))
    queries = forms.where("kind = 'variant'").select(F.col("form_id").alias("qid"), F.regexp_replace("form", r"[-*]", " ").alias("query"))
    got = P.search(queries, P.prepare_lexicon(lex, profiles.GREEK), profiles.GREEK, rules.compile_rules(RULES), results=5)
    return got.select(
        "qid", "query", "mode", "path", "rank", "id", "headword", F.round("confidence", 6).alias("confidence"), "match_type", "uncertainty", "bucket",
        F.array_join("applied_rules", ",").alias("applied_rules"), "drawing",
    )


def search_self(spark, d):
    """Every standard form searched among the standard forms: it is its own best match, or sounds like it."""
    forms = table(spark, d, "word_forms").where("kind = 'standard' and form not like '%-%' and form not like '%*%'")
    lex = forms.select(F.col("form_id").cast("string").alias("id"), F.col("form").alias("headword"), S.to_ipa("form").alias("ipa"), F.lit("attic").alias("dialect"))
    got = P.search(forms.select(F.col("form_id").alias("qid"), F.col("form").alias("query")), P.prepare_lexicon(lex, profiles.GREEK), profiles.GREEK, results=1)
    return got.select("qid", "query", F.col("rank").cast("bigint").alias("rank"), "confidence", "match_type", "uncertainty", "bucket")


def record_search(spark, d):
    """Spellings of every record whose id is divisible by 20, searched among all word forms: the best headword of each."""
    rows = table(spark, d, "choice_records").where("record_id % 20 = 0 and trim(original) <> ''").select("record_id", "original")
    texts = rows.select(F.regexp_replace("original", S.MARKER, " ").alias("query")).where("trim(query) <> ''").distinct()
    texts = texts.withColumn("qid", F.sha2("query", 256))
    forms = table(spark, d, "word_forms").select(F.col("form_id").cast("string").alias("id"), F.col("form").alias("headword"), S.to_ipa("form").alias("ipa"), F.lit("attic").alias("dialect"))
    best = P.search(texts, P.prepare_lexicon(forms, profiles.GREEK), profiles.GREEK, rules.compile_rules(RULES), results=1)
    best = best.select("query", "headword", F.round("confidence", 6).alias("confidence"), "match_type", "path")
    return rows.withColumn("query", F.regexp_replace("original", S.MARKER, " ")).join(best, "query", "left").select("record_id", "headword", "confidence", "match_type", "path")


def growing_search(spark, d):
    """Spellings of every record whose id is divisible by 20, searched among the distinct regularised texts of all records: both sides grow."""
    c = table(spark, d, "choice_records")
    words = lambda column: F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"([\p{IsGreek}\p{M}]+)"), 1)))
    lex = c.select(words("regularized").alias("headword")).distinct()
    lex = lex.select(F.col("headword").alias("id"), "headword", S.to_ipa("headword").alias("ipa"), F.lit("attic").alias("dialect"))
    queries = c.where("record_id % 20 = 0").select(words("original").alias("query")).distinct().select(F.sha2("query", 256).alias("qid"), "query")
    best = P.search(queries, P.prepare_lexicon(lex, profiles.GREEK), profiles.GREEK, rules.compile_rules(RULES), results=1)
    return best.select("query", "headword", F.round("confidence", 6).alias("confidence"), "match_type", "path")


# Own small rule set over the spelling alternations of the test data.
RULES = [
    {"id": "VOW-001", "name_en": "e and ai", "input": "e", "output": "ai", "dialects": ["koine"]},
    {"id": "VOW-002", "name_en": "o and long o", "input": "o", "output": "ɔː", "dialects": ["koine"]},
    {"id": "VOW-003", "name_en": "long o and o", "input": "ɔː", "output": "o", "dialects": ["koine"]},
    {"id": "VOW-004", "name_en": "long e and i", "input": "ɛː", "output": "i", "dialects": ["koine"]},
    {"id": "VOW-005", "name_en": "ei and i", "input": "eː", "output": "i", "dialects": ["koine"]},
    {"id": "VOW-006", "name_en": "y and ou", "input": "oː", "output": "y", "dialects": ["ionic"]},
    {"id": "CON-001", "name_en": "liquid exchange", "input": "l", "output": "r", "dialects": ["egyptian"]},
    {"id": "CON-002", "name_en": "ss and tt", "input": "ss", "output": "tt", "dialects": ["attic"]},
    {"id": "CON-003", "name_en": "final n lost", "input": "n", "output": "", "context": "_#", "dialects": ["koine"]},
    {"id": "CON-004", "name_en": "nasal before velar", "input": "ɡ", "output": "n", "context": "_{k,kʰ,ɡ}"},
    {"id": "CON-005", "name_en": "intervocalic glide", "input": "", "output": "i", "context": "V_V", "is_insertion": True},
]


def _pairs(spark, d):
    """Distinct spelling pairs of the correspondence entries as phones, with their local alignment."""
    c = table(spark, d, "correspondence_entries").select("original", "normalized").distinct()
    c = c.select("original", "normalized", S.tokenize(S.to_ipa("original")).alias("q"), S.tokenize(S.to_ipa("normalized")).alias("l"))
    return c.withColumn("sw", align.local_alignment_udf({}, list(S.PHONES))("q", "l"))


def explain_rules(spark, d):
    a = _pairs(spark, d).withColumn("apps", rules.explain_udf(rules.compile_rules(RULES))("sw.alignment", F.struct(F.col("normalized").alias("id"))))
    return a.select("original", "normalized", F.inline("apps")).groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("original", "normalized").alias("pairs"))


def weighted_edit_distance(spark, d):
    matrix = {"e": {"ai": 0.2}, "o": {"ɔː": 0.2}, "i": {"ɛː": 0.3, "eː": 0.2}, "l": {"r": 0.5}}
    p = _pairs(spark, d)
    return p.select(
        "original", "normalized", F.round(align.weighted_distance(F.col("q"), F.col("l"), matrix, list(S.PHONES)), 6).alias("raw"),
        F.round(align.normalised_distance(F.col("q"), F.col("l"), matrix), 6).alias("normalised"), F.round(align.confidence(F.col("sw.score"), F.col("q"), F.col("l")), 6).alias("confidence"),
    )


def alternation_probabilities(spark, d):
    c = table(spark, d, "correspondence_entries").select("original", "normalized")
    return labels.probabilities(c.select(labels.alternations(F.col("original"), F.col("normalized")).alias("labels")))


def _with(query, words):
    return lambda spark, d: query(spark, d, words)


#: Queries on the few words of ``QUERY_WORDS``; those that end in _all take their words from the tables.
SEARCHES = ("seed_topk", "unigram_fallback", "proximity_topk", "length_band_round_robin", "candidate_union_mincost", "cascade_vs_union", "ladder_rank", "additive_rerank")
JOINS = ("fuzzy_join_d1", "fuzzy_join_d2", "unit_normalized_distance", "collapse_join")

QUERIES = {
    "lexicon_tokens": lexicon_tokens, "consonant_skeleton": consonant_skeleton, "kmer_postings": kmer_postings, "seed_topk": seed_topk, "unigram_fallback": unigram_fallback,
    "proximity_topk": proximity_topk, "length_band_round_robin": length_band_round_robin, "headword_dedup": headword_dedup, "fuzzy_join_d1": _fuzzy(1), "fuzzy_join_d2": _fuzzy(2),
    "unit_normalized_distance": unit_normalized_distance, "wildcard_prefix": _wild("mar-"), "wildcard_suffix": _wild("-ne"), "wildcard_infix": _wild("l-er"), "collapse_keys": collapse_keys,
    "collapse_join": collapse_join, "candidate_union_mincost": candidate_union_mincost, "cascade_vs_union": cascade_vs_union, "ladder_rank": ladder_rank, "additive_rerank": additive_rerank,
    "pair_counts": pair_counts, "indel_free_log_odds": indel_free_log_odds, "word_freq": _grams(1), "ngrams_bi": _grams(2), "ngrams_tri": _grams(3), "stupid_backoff": stupid_backoff,
    "context_lag2": context_lag2, "doc_split": doc_split, "doc_split_stratified": doc_split_stratified, "recall_at_k": recall_at_k, "rank_profile": rank_profile,
    "rank_percentiles": rank_percentiles, "discordant_counts": discordant_counts, "facet_three_valued": facet_three_valued, "failure_buckets": failure_buckets,
    "latency_percentiles": latency_percentiles, "ols_fit": ols_fit, "match_type_buckets": match_type_buckets, "hierarchy_rules": hierarchy_rules, "catalog_filter_page": catalog_filter_page,
    "catalog_foreign_keys": catalog_foreign_keys, "left_enrich_array": left_enrich_array, "drop_reasons": drop_reasons,
    "sw_search": sw_search, "search_self": search_self, "record_search": record_search, "growing_search": growing_search, "explain_rules": explain_rules, "weighted_edit_distance": weighted_edit_distance, "learned_log_odds": learned_log_odds, "cluster_bootstrap": cluster_bootstrap,
    "mcnemar": mcnemar, "form_keys": form_keys, "markup_classes": markup_classes, "alternation_probabilities": alternation_probabilities,
}
QUERIES |= {f"{n}_all": _with(QUERIES[n], row_words) for n in SEARCHES} | {f"{n}_all": _with(QUERIES[n], all_words) for n in JOINS}
QUERIES |= {f"wildcard_{shape}_all": _wild_all(shape) for shape in PATTERNS}
QUERIES |= {"word_freq_all": _grams(1, True), "ngrams_bi_all": _grams(2, True), "ngrams_tri_all": _grams(3, True), "stupid_backoff_all": stupid_backoff_all, "doc_split_stratified_all": doc_split_stratified_all}

# --- SQL ------------------------------------------------------------------------

_W = """w as (select word, count(*)::bigint as freq from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by 1),
t as (select word, freq, regexp_extract_all(word, 'th|sh|ch|ph|[a-z]') as tok from w),
s as (select *, list_filter(tok, lambda x: not list_contains(['a','e','i','o','u'], x)) as sk from t),
k2 as (select word, unnest(list_distinct(list_transform(range(1, len(sk)), lambda i: sk[i] || ' ' || sk[i+1]))) as kmer from s where len(sk) >= 2)"""
_Q = "q as (select unnest([" + ", ".join(f"'{w}'" for w in QUERY_WORDS) + "]) as query)"
_QS = f"""{_Q}, qt as (select query, regexp_extract_all(query, 'th|sh|ch|ph|[a-z]') as tok from q),
qs as (select *, list_filter(tok, lambda x: not list_contains(['a','e','i','o','u'], x)) as sk from qt),
qk as (select query, kmer, count(*) as n from (select query, unnest(list_transform(range(1, len(sk)), lambda i: sk[i] || ' ' || sk[i+1])) as kmer from qs where len(sk) >= 2) group by 1, 2),
seed as (select *, row_number() over (partition by query order by score desc, word) as rank from (select query, word, sum(n)::bigint as score from qk join k2 using (kmer) group by 1, 2))"""
_DEG = "translate(X, 'cqzy', 'kksi')"
for _c in "abdefghijklmnoprstuvwx":
    _DEG = f"regexp_replace({_DEG}, '{_c}{_c}+', '{_c}', 'g')"


def _deg(x: str) -> str:
    return _DEG.replace("X", x)


_GEN = f"""lk as (select word, freq, {_deg('word')} as lk from w), qc as (select query, {_deg('query')} as qk from q),
blind0 as (select query, word, levenshtein(query, word) as dist, freq from q join w on abs(length(query) - length(word)) <= 2 where levenshtein(query, word) between 1 and 2),
gen as (
 select query, word, 0.0::double as cost, freq, 1 as st from q join w on query = word
 union all select query, word, 1.0, freq, 2 from qc join lk on qk = lk
 union all select query, word, 3.0, freq, 3 from qc join lk on abs(length(qk) - length(lk)) <= 1 and levenshtein(qk, lk) = 1
 union all select query, word, 0.5 + dist, freq, 4 from (select *, row_number() over (partition by query order by dist, freq desc, word) as rn from blind0) where rn <= 300),
u as (select query, word, min(cost) as cost, any_value(freq) as freq from gen group by 1, 2)"""
_S = """sent as (select regexp_extract_all(s, '[a-z]+') as tok from (select unnest(regexp_split_to_array(lower(text), '[.;\\n]+')) as s from documents)),
p as (select list_concat(['<s>', '<s>'], tok, ['</s>']) as p from sent where len(tok) > 0),
g1 as (select w1, count(*)::bigint as count from (select unnest(p) as w1 from p) group by 1),
g2 as (select w1, w2, count(*)::bigint as count from (select p[i] as w1, p[i+1] as w2 from (select p, unnest(range(2, len(p))) as i from p)) group by 1, 2),
g3 as (select w1, w2, w3, count(*)::bigint as count from (select p[i] as w1, p[i+1] as w2, p[i+2] as w3 from (select p, unnest(range(1, len(p) - 1)) as i from p)) group by 1, 2, 3)"""
_HF = "('0x' || substr(sha256('split-1' || doc_id::varchar), 1, 13))::bigint / 4503599627370496.0"
_R = """r as (select entry_id, review_status as split, kind as doc, nullif(list_position(candidate_headwords, normalized), 0) - 1 as rank, len(candidate_headwords) as n_cand, confidence from correspondence_entries)"""
_LP = f"""with {_W}, pr as (select a.word as x, b.word as y from w a join w b on a.word < b.word and length(a.word) = length(b.word) where levenshtein(a.word, b.word) <= 1),
c as (select least(x[i], y[i]) as a, greatest(x[i], y[i]) as b from (select x, y, unnest(range(1, length(x) + 1)) as i from pr)), n as (select a, b, count(*)::bigint as n from c group by 1, 2)"""


def _split_sql(part: str, source: str) -> str:
    return f"""with x as (select doc_id, n_chars, {_HF} as h, {part} as s from {source})
select doc_id, case when coalesce(sum(n_chars) over (partition by s order by h, doc_id rows between unbounded preceding and 1 preceding), 0) < 0.30 * sum(n_chars) over (partition by s) then 'dev' else 'test' end as split from x"""


_CLEAN = r"""nfc_normalize(regexp_replace(translate(translate(regexp_replace({0}, '\|[^|]*\|', '', 'g'), '̣∼∽∤⸢⸣⸤⸥⊢⊣⋰⋱〚〛⟦⟧⸌⸍⸮?!()[]⎴⎵⸜⸝⦑⦒⧼…⁽⁾-~<>{{}}❨❩' || chr(57792), ''), 'ocABEZHIKMNOPTXY', 'οϲΑΒΕΖΗΙΚΜΝΟΡΤΧΥ'),
 '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"""
ORACLE_SQL = {
    "lexicon_tokens": f"with {_W} select word, freq, array_to_string(tok, ' ') as tokens, len(tok) as n_tokens from t",
    "consonant_skeleton": f"with {_W} select word, array_to_string(sk, ' ') as skeleton from s",
    "kmer_postings": f"with {_W} select kmer, word from k2",
    "seed_topk": f"with {_W}, {_QS} select query, word, score, rank from seed where rank <= 25",
    "unigram_fallback": f"""with {_W}, {_QS}, b as (select * from qs where query not in (select query from seed)),
h as (select distinct b.query, s.word, abs(len(s.tok) - len(b.tok)) as delta from b, s where list_has_any(b.sk, s.sk))
select query, word, rank from (select query, word, row_number() over (partition by query order by delta, word <> query, word) as rank from h) where rank <= 20""",
    "proximity_topk": f"""with {_W}, {_QS} select query, word, rank from (select qs.query, t.word, row_number() over (partition by qs.query order by abs(len(t.tok) - len(qs.tok)), t.word <> qs.query, t.word) as rank from qs, t) where rank <= 20""",
    "length_band_round_robin": f"""with {_W}, {_QS}, r as (select seed.query, seed.word, abs(len(t.tok) - len(qt.tok)) as delta, rank from seed join t on t.word = seed.word join qt on qt.query = seed.query where rank > 25),
n as (select *, row_number() over (partition by query, delta order by rank) as rn from r where delta <= 2)
select query, word, delta, turn from (select *, row_number() over (partition by query order by rn, delta) as turn from n) where turn <= 25""",
    "headword_dedup": "select p_name as headword, arg_min(p_partkey, (-p_retailprice, p_partkey)) as p_partkey, max(p_retailprice) as p_retailprice from part group by 1",
    **{f"fuzzy_join_d{k}": f"with {_W}, {_Q} select query, word, levenshtein(query, word) as dist from q join w on abs(length(query) - length(word)) <= {k} where levenshtein(query, word) <= {k}" for k in (1, 2)},
    "unit_normalized_distance": f"with {_W}, {_Q} select query, word, round(levenshtein(query, word) / greatest(length(query), length(word)), 6) as distance from q join w on abs(length(query) - length(word)) <= 2 where levenshtein(query, word) <= 2",
    "wildcard_prefix": f"with {_W} select 'mar-' as query, word, 1::bigint as fragments, 3::bigint as overlap from w where word like 'mar%'",
    "wildcard_suffix": f"with {_W} select '-ne' as query, word, 1::bigint as fragments, 2::bigint as overlap from w where word like '%ne'",
    "wildcard_infix": f"with {_W} select 'l-er' as query, word, 2::bigint as fragments, 3::bigint as overlap from w where word like '%l%er%'",
    "collapse_keys": f"with {_W} select word, {_deg('word')} as key from w",
    "collapse_join": f"with {_W}, {_Q} select query, word from q join w on {_deg('query')} = {_deg('word')}",
    "candidate_union_mincost": f"with {_W}, {_Q}, {_GEN} select * from u",
    "cascade_vs_union": f"""with {_W}, {_Q}, {_GEN}, f as (select query, min(st) as st from gen group by 1)
select query, ['exact', 'rules', 'rules_fuzzy', 'blind'][st] as stage, count(distinct case when gen.st = f.st then word end) as n_cascade, count(distinct word) as n_union from gen join f using (query) group by query, f.st""".replace("[st]", "[f.st]"),
    "ladder_rank": f"with {_W}, {_Q}, {_GEN} select query, word, row_number() over (partition by query order by cost, freq desc, word) - 1 as rank from u",
    "additive_rerank": f"with {_W}, {_Q}, {_GEN}, x as (select query, word, round(ln(1 + freq) + 0.5 * ln(1 + freq) - 3 * cost, 6) as score from u) select query, word, score, row_number() over (partition by query order by score desc, word) - 1 as rank from x",
    "pair_counts": f"{_LP} select a, b, n from n",
    "indel_free_log_odds": f"""{_LP}, e as (select p, sum(n) as k from (select a as p, n from n union all select b, n from n) group by 1), z as (select sum(n) as t from n), m as (select count(*) as m from e)
select x.p as a, y.p as b, coalesce(n.n, 0) as n, round(log2(((coalesce(n.n, 0) + 1.0) / (t + m * (m + 1) / 2)) / (case when x.p = y.p then 1 else 2 end * (x.k / (2.0 * t)) * (y.k / (2.0 * t)))), 6) as score
from e x join e y on x.p <= y.p left join n on n.a = x.p and n.b = y.p, z, m""",
    "word_freq": f"with {_S} select * from g1",
    "ngrams_bi": f"with {_S} select * from g2",
    "ngrams_tri": f"with {_S} select * from g3",
    "stupid_backoff": f"""with {_S} select g3.w1, g3.w2, round(ln(g3.count / c.count), 6) as score from g3 join g2 c on c.w1 = g3.w1 and c.w2 = g3.w2 where g3.w3 = '</s>'
union all select g3.w1, g3.w2, round(ln(0.4 * b.count / u.count), 6) from g3 join g2 b on b.w1 = g3.w2 and b.w2 = g3.w3 join g1 u on u.w1 = g3.w2 where g3.w3 = '</s>' and (g3.w1, g3.w2) not in (select (w1, w2) from g2)""",
    "context_lag2": "select event_id, lag(event_type, 1, '<s>') over w as prev1, lag(event_type, 2, '<s>') over w as prev2 from events window w as (partition by user_id order by ts, event_id)",
    "doc_split": _split_sql("'all'", "documents"),
    "doc_split_stratified": _split_sql("s", "(select doc_id, n_chars, case when lang in (select lang from documents where lang is not null group by 1 order by sum(n_chars) desc, lang limit 4) then lang else 'other' end as s from documents)"),
    "recall_at_k": f"""with {_R} select case when grouping(split) = 1 then 'all' else split end as split, count(*) as n, count(*) filter (n_cand = 0) as empty, count(*) filter (rank < 1) as hit_1, count(*) filter (rank < 5) as hit_5,
count(*) filter (rank < 10) as hit_10, count(rank) as hit_any from r group by rollup(split)""",
    "rank_profile": f"""with {_R}, o as (select list_sort(list(rank)) as l from r where rank is not null), c as (select doc, bool_and(coalesce(rank < 5, false)) as c5, bool_and(coalesce(rank < 20, false)) as c20 from r group by 1)
select count(*) as n, round(1 - count(rank) / count(*), 6) as unresolved, {", ".join(f"round(count(*) filter (rank < {k}) / count(*), 6) as recall_{k}" for k in evaluation.CUTS)},
any_value(o.l[(len(o.l) * 0.5)::int + 1]) as rank_median, any_value(o.l[least(floor(len(o.l) * 0.9)::int, len(o.l) - 1) + 1]) as rank_p90,
round((select avg(c5::int) from c), 6) as doc_coverage_5, round((select avg(c20::int) from c), 6) as doc_coverage_20 from r, o""".replace("(len(o.l) * 0.5)::int", "floor(len(o.l) * 0.5)::int"),
    "rank_percentiles": f"with {_R}, o as (select list_sort(list(n_cand)) as l from r) select p, l[least(floor(len(l) * p), len(l) - 1)::int + 1] as value from o, (select unnest([0.5, 0.9, 1.0]::double[]) as p)",
    "discordant_counts": "select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from (select hits_a / n_tokens >= 0.5 as a, coalesce(hits_b, 0) / n_tokens >= 0.5 as b from results_lm_paired where n_tokens > 0)",
    "facet_three_valued": f"""with {_R}, f as (select rank, confidence <> 'low' as f1, case when n_cand > 0 then n_cand <= 2 end as f2 from r)
select 'conservative' as policy, count(*) as kept, count(rank) as gold_kept from f where coalesce(f1, true) and coalesce(f2, true)
union all select 'aggressive', count(*), count(rank) from f where coalesce(f1, false) and coalesce(f2, false)""",
    "failure_buckets": f"with {_R} select case when rank < 1 then 'hit' when n_cand = 0 then 'unreachable' when rank is not null then 'ranking' else 'generation' end as bucket, count(*) as n from r group by 1",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 1.0), 6) as p100 from events group by 1",
    "ols_fit": "select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 4) as r2, round(regr_avgx(l_extendedprice, l_quantity), 4) as mean_x, round(regr_sxx(l_extendedprice, l_quantity), 4) as sxx, regr_count(l_extendedprice, l_quantity)::bigint as n from lineitem",
    "match_type_buckets": """with x as (select hits_a / n_tokens as c, coalesce(hits_b > hits_a, false) as r from results_lm_paired where n_tokens > 0),
y as (select *, case when c >= 1 then 'Exact' when r then 'Rule-based' when c < 0.55 then 'Low-confidence' else 'Distance-only' end as match_type from x),
z as (select *, case when match_type = 'Exact' or (r and c >= 0.8) then 'Low' when c >= 0.7 then 'Medium' else 'High' end as uncertainty from y)
select match_type, uncertainty, case when match_type in ('Exact', 'Rule-based') or uncertainty = 'Low' then 'Supported' else 'Exploratory' end as bucket, count(*) as n from z group by 1, 2, 3""",
    "hierarchy_rules": f"""with recursive {_LATEST},
lr as (select v, arg_max(rules, (loaded_at, row_id)) as rules from (select lower(trim(id)) as v, rules, loaded_at, row_id from buck_dialects) group by 1),
own as (select distinct v, unnest(rules) as rule from lr),
up(a, d, steps) as (select p, v, 1 from links where p is not null union select l.p, u.d, u.steps + 1 from up u join links l on l.v = u.a where l.p is not null and u.steps <= (select count(*) from links) and u.a <> u.d)
select d as dialect, rule, min(steps)::bigint as depth from (select d, rule, steps from up join own on own.v = up.a union all select v, rule, 0 from own) group by 1, 2""",
    "mcnemar": """with x as (select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from (select hits_a / n_tokens >= 0.5 as a, coalesce(hits_b, 0) / n_tokens >= 0.5 as b from results_lm_paired where n_tokens > 0))
select only_a, only_b, round(least(1.0, 2 * (select sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0::double))) from (select unnest(range(least(only_a, only_b) + 1)) as i))), 9) as p_value from x""",
    "markup_classes": f"""with w as (select original as o, {_CLEAN.format('original')} as a, {_CLEAN.format('regularized')} as b from choice_records where regularized is not null)
select case when regexp_matches(o, '[❨❩]') then 'abbrev' when a = b then 'clean' else 'variant' end as class, regexp_matches(a, '(?s)[^\\x{{300}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}ʼ’'']') as has_residue, count(*) as n from w group by 1, 2""",
    "search_self": "select form_id as qid, form as query, 1::bigint as rank, 1.0::double as confidence, 'Exact' as match_type, 'Low' as uncertainty, 'Supported' as bucket from word_forms where kind = 'standard' and form not like '%-%' and form not like '%*%'",
    "catalog_filter_page": "select p_partkey, p_name, p_brand, total from (select p_partkey, p_name, p_brand, count(*) over () as total from part where p_brand = 'Brand#13') order by p_name, p_partkey limit 20 offset 10",
    "catalog_foreign_keys": """select entry_id, 'rule_id' as key, rule_id as value from buck_glossary where rule_id is not null and rule_id not in (select id from buck_rules where id is not null)
union all select entry_id, 'dialect', lower(trim(dialect)) from buck_glossary where dialect is not null and lower(trim(dialect)) not in (select lower(trim(id)) from buck_dialects where id is not null)""",
    "left_enrich_array": "select o_orderkey, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber, l_partkey), '') as line_numbers, count(l_orderkey) as n_lines from orders left join lineitem on l_orderkey = o_orderkey group by 1",
    "drop_reasons": """select reason, count(*) as n from (select unnest(list_filter([case when n_chars < 200 then 'short' end, case when n_chars > 10000 then 'long' end, case when lang is null then 'no_lang' end,
case when source is null then 'no_source' end, case when not regexp_matches(text, '[a-z]{3}') then 'no_words' end], lambda x: x is not null)) as reason from documents) group by 1""",
}
_QR = "q as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as query from documents where doc_id % 20 = 0)"
_QA = "q as (select word as query from w)"
ORACLE_SQL |= {f"{n}_all": ORACLE_SQL[n].replace(_Q, _QR) for n in SEARCHES} | {f"{n}_all": ORACLE_SQL[n].replace(_Q, _QA) for n in JOINS}
for _shape, _part, _edge in (("prefix", "left(query, 3)", "tok[1:len(f)]"), ("suffix", "right(query, 2)", "tok[len(tok) - len(f) + 1:len(tok)]")):
    _name = "f || '-'" if _shape == "prefix" else "'-' || f"
    ORACLE_SQL[f"wildcard_{_shape}_all"] = f"""with {_W}, {_QR}, pt as (select distinct {_part} as f from q), pf as (select {_name} as query, regexp_extract_all(f, 'th|sh|ch|ph|[a-z]') as f from pt)
select query, word, 1::bigint as fragments, len(f)::bigint as overlap from pf, t where len(f) <= len(tok) and {_edge} = f"""
_SA = _S.replace("lower(text)", "replace(lower(nfc_normalize(text)), 'ς', 'σ')").replace("'[a-z]+'", "'[\\p{L}\\p{M}]+'")
ORACLE_SQL |= {f"{n}_all": ORACLE_SQL[n].replace(_S, _SA) for n in ("word_freq", "ngrams_bi", "ngrams_tri")}
_SB = _SA.replace("from documents)", "from documents where doc_id % 20 <> 0)")
_ST = _SA[: _SA.index("g1 as")].replace("sent as", "sent_a as").replace("p as (", "p_a as (").replace("from sent ", "from sent_a ")
ORACLE_SQL["stupid_backoff_all"] = f"""with {_SB}, {_ST}t as (select distinct p[i] as w1, p[i+1] as w2, p[i+2] as w3 from (select p, unnest(range(1, len(p) - 1)) as i from p_a)),
b2 as (select * from g2 union all select '<s>', '<s>', count(*) from p), n as (select sum(count) as n from g1)
select t.w1, t.w2, t.w3, round(ln(coalesce(g3.count / c.count, 0.4 * b.count / u.count, 0.4 * 0.4 * w.count / n.n, 0.4 * 0.4 * 0.4 / n.n)), 6) as score from t
left join g3 on g3.w1 = t.w1 and g3.w2 = t.w2 and g3.w3 = t.w3 left join b2 c on c.w1 = t.w1 and c.w2 = t.w2
left join b2 b on b.w1 = t.w2 and b.w2 = t.w3 left join g1 u on u.w1 = t.w2 left join g1 w on w.w1 = t.w3, n"""
_LANGS = "(select doc_id, n_chars, nullif(lower(trim(lang)), '') as lang from documents)"
ORACLE_SQL["doc_split_stratified_all"] = _split_sql("s", f"(select doc_id, n_chars, case when lang in (select lang from {_LANGS} group by 1 order by sum(n_chars) desc, lang limit 20) then lang else 'other' end as s from {_LANGS})")
