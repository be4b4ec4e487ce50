"""Near pairs of long words: only what lies between their equal ends is filled in."""

import time

from pyspark.sql import functions as F

from lexiloom.operators import align


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_ends_are_cut_without_changing_the_distance(spark):
    words = ["", "a", "aa", "ab", "ba", "aba", "aab", "abab", "babab", "abcab", "cabab", "abba"]
    pairs = [(list(a), list(b)) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", align.normalised_distance(F.col("a"), F.col("b"), {}).alias("d")).collect()
    assert all(r["d"] == distance(r["a"], r["b"]) / max(len(r["a"]), len(r["b"]), 1) for r in rows) and len(rows) == len(pairs)


def test_long_near_pairs_are_quick(spark):
    text = F.split(F.concat(F.repeat(F.lit("abcdefghij"), 60), F.col("id").cast("string")), "")
    rows = spark.range(400).select(align.normalised_distance(text, F.split(F.concat(F.repeat(F.lit("abcdefghij"), 60), (F.col("id") + 1).cast("string")), ""), {}).alias("d"))
    began = time.time()
    assert 0 < rows.agg(F.max("d")).first()[0] < 0.01
    assert time.time() - began < 30
