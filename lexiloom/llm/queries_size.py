"""Queries p7_ and p8_: mixtures by tokens and pieces of oversized texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import chunking, mixing, tokens
from lexiloom.session import Scratch


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the counted documents (written once, as texts are encoded once) and the targets."""
    counted = Scratch(spark, "mix").write(mixing.counted(_documents(spark, d)), "counted")
    targets = spark.read.parquet(f"{d}/mix_targets.parquet")
    return mixing.mix(counted, targets), counted, targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def _by_chars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents sized by their characters, which SQL can count, and the targets."""
    return _documents(spark, d).select("doc_id", "source", "n_chars"), spark.read.parquet(f"{d}/mix_targets.parquet")


def p7_mix_by_chars(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_by_chars(spark, d), size="n_chars")


def p7_shares_by_chars(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = _by_chars(spark, d)
    got = mixing.shares(mixing.mix(docs, targets, size="n_chars"), docs, targets, size="n_chars")
    return got.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each target's repetition rate, the share it can reach and what holds it back."""
    counted = Scratch(spark, "mix").write(mixing.counted(_documents(spark, d)), "counted")
    got = mixing.rates(counted, spark.read.parquet(f"{d}/mix_targets.parquet"))
    return got.select("source", "target_share", "reachable", "rate", (F.col("rate") >= F.col("max_repeats")).alias("at_bound"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that were cut: those with a second piece."""
    return chunking.pieces(_documents(spark, d)).where("piece = 1").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text in pieces within the limit; short texts are one piece, untouched."""
    return _pieces(spark, d).select("doc_id", "piece", "char_start", "char_end", "piece_text")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    cut = chunking.pieces(docs).select("doc_id", "piece", "char_start", "new_start", "char_end", "piece_text")
    short = docs.where(F.octet_length("text") <= chunking.LIMIT).where("text <> ''")
    zero = F.lit(0)
    short = short.select("doc_id", zero.alias("piece"), zero.alias("char_start"), zero.alias("new_start"), F.length("text").alias("char_end"), F.col("text").alias("piece_text"))
    return cut.unionByName(short)


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each text's digest, of what its pieces give back without their overlaps."""
    new = _pieces(spark, d).select("doc_id", F.struct("piece", F.expr("substring(piece_text, new_start - char_start + 1)").alias("new")).alias("part"))
    # as much as one text
    parts = new.groupBy("doc_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.count("*").alias("n"))
    return parts.select("doc_id", F.md5(F.array_join(F.transform("parts", lambda x: x["new"]), "")).alias("digest"))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    """Pieces with too many tokens, or that do not repeat the last ones of the piece before, counted anew; there must be none.

    Encoded alone, a repeated part may join its first characters otherwise than in the text, hence the few tokens of play.
    """
    p = _pieces(spark, d).withColumn("again", F.expr("substring(piece_text, 1, new_start - char_start)")).drop("new_start")
    sized = tokens.with_token_counts(p.select("doc_id", "piece", "again", "piece_text"), ["doc_id", "piece", "again"], "piece_text", "n_tokens")
    both = tokens.with_token_counts(sized, ["doc_id", "piece", "n_tokens"], "again", "n_again")
    return both.where(f"n_tokens > {chunking.LIMIT} or (piece > 0 and n_again not between {chunking.OVERLAP - 4} and {chunking.OVERLAP + 7})")


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_rates": p7_rates, "p7_mix_by_chars": p7_mix_by_chars, "p7_shares_by_chars": p7_shares_by_chars, "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_restored": p8_restored, "p8_faults": p8_faults}

# The level of the water is found by bisection here, the operator has it in closed form.
_RATES = """with recursive a as (select source, sum(n_chars)::double as tokens, count(*) as documents from documents group by 1),
t as (select m.source, target_share, max_repeats, coalesce(tokens, 0) as tokens, coalesce(documents, 0) as documents,
  case when tokens > 0 and target_share > 0 and max_repeats > 0 then target_share end as s from mix_targets m left join a on a.source = m.source),
u as (select *, s / sum(s) over () as share from t),
want as (select sum(tokens) as w, max(tokens * max_repeats / share) as top from u where share is not null),
lv(k, lo, hi) as (select 0, 0::double, top from want
  union all select k + 1, case when f < w then (lo + hi) / 2 else lo end, case when f < w then hi else (lo + hi) / 2 end
  from (select *, (select sum(least(tokens * max_repeats, share * (lo + hi) / 2)) from u) as f from lv), want where k < 200),
r as (select *, case when share is null then 0 else least(max_repeats, share * (select hi from lv where k = 200) / tokens) end as rate from u),
x as (select doc_id, source, n_chars, floor(rate)::int + (('0x' || substr(md5('SEED:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < rate - floor(rate))::int as n
  from documents join r using (source)),
mixed as (select doc_id, source, n_chars, unnest(range(1, n + 1))::int as copy from x where n > 0)
""".replace("SEED", str(mixing.SEED))
ORACLE_SQL = {
    "p8_restored": "select doc_id, md5(text) as digest from documents where text <> ''",
    # what must not be
    "p8_faults": "select doc_id, 0 as piece, 0::bigint as n_tokens, 0::bigint as n_again from documents where false",
    "p7_mix_by_chars": _RATES + "select doc_id, source, n_chars, copy from mixed",
    "p7_shares_by_chars": _RATES + """, g as (select source, count(*) as used, sum(n_chars)::bigint as used_tokens, max(copy) as most_repeats from mixed group by 1)
select source, target_share, max_repeats, tokens::bigint as tokens, documents, round(share, 9) as share, round(rate, 9) as rate, coalesce(used, 0) as used, coalesce(used_tokens, 0) as used_tokens,
coalesce(most_repeats, 0) as most_repeats, round(rate * tokens / sum(rate * tokens) over (), 9) as reachable, round(coalesce(used_tokens, 0) / sum(used_tokens) over (), 9) as actual_share from r left join g using (source)""",
}
