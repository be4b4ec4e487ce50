"""n-gram counts and stupid-backoff scores, as explodes, grouped counts and left joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
# Fixed value: the backoff factor.
ALPHA = 0.4


def padded(tokens: Column | str) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.concat(F.array(F.lit(BOS), F.lit(BOS)), t, F.array(F.lit(EOS)))


def ngrams(tokens: Column | str, n: int) -> Column:
    """ARRAY<STRUCT<w1..wn>> of the padded sentence: unigrams with both opening marks, bigrams from the second, trigrams whole.

    Shifted copies are zipped, which stays in generated code.
    """
    p = padded(tokens)
    first = 2 if n == 2 else 1
    many = F.size(p) - (n - 1) - (first - 1)
    return F.arrays_zip(*[F.slice(p, F.lit(first + i), many).alias(f"w{i + 1}") for i in range(n)])


def counts(sentences: DataFrame, tokens: str, n: int) -> DataFrame:
    """(w1..wn, count); rows without tokens are left out.  Counts combine before the shuffle."""
    words = [f"w{i + 1}" for i in range(n)]
    rows = sentences.where(F.size(tokens) > 0).select(F.inline(ngrams(tokens, n)).alias(*words))
    return rows.groupBy(*words).agg(F.count("*").alias("count"))


def backoff(triples: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame, total: Column, alpha: float = ALPHA) -> DataFrame:
    """``triples`` (w1, w2, w3 = word) with ``score``: log of the longest known context's relative frequency."""
    u = lambda c, name: uni.select(F.col("w1").alias(c), F.col("count").alias(name))
    b = lambda x, y, name: bi.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("count").alias(name))
    out = (
        triples.join(tri.select("w1", "w2", "w3", F.col("count").alias("_t")), ["w1", "w2", "w3"], "left")
        .join(b("w1", "w2", "_ctx2"), ["w1", "w2"], "left")
        .join(b("w2", "w3", "_b"), ["w2", "w3"], "left")
        .join(u("w2", "_ctx1"), "w2", "left")
        .join(u("w3", "_u"), "w3", "left")
    )
    p = F.coalesce(F.col("_t") / F.col("_ctx2"), alpha * F.col("_b") / F.col("_ctx1"), alpha**2 * F.col("_u") / total, alpha**3 / total)
    return out.withColumn("score", F.log(p)).drop("_t", "_ctx2", "_b", "_ctx1", "_u")
