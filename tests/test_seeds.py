"""The best seeds of all queries at once, against scoring pair by pair."""

import random
import time
from collections import Counter

import pytest

from lexiloom.operators import seeds
from lexiloom.plans import reference_queries as R


def brute(queries, entries, near=0, each=0, most=3):
    want = set()
    for qid, kmers, n in queries:
        have = Counter(kmers)
        scored = sorted((-sum(have[k] for k in ks), i, abs(m - n)) for i, ks, m in entries if set(ks) & set(kmers))
        want |= {(qid, i, -s, d, pos) for pos, (s, i, d) in enumerate(scored, 1) if pos <= most}
        for delta in range(near + 1) if each else ():
            want |= {(qid, i, -s, d, None) for s, i, d in [x for x in scored[most:] if x[2] == delta][:each]}
    return want


@pytest.mark.parametrize("each", [0, 2])
def test_blocks_give_the_best_of_all(spark, monkeypatch, each):
    monkeypatch.setattr(seeds, "ENTRIES", 7)
    monkeypatch.setattr(seeds, "QUERIES", 4)
    monkeypatch.setattr(seeds, "ROWS", 2)
    ks = [f"{a} {b}" for a in "bcd" for b in "bcd"]
    entries = [(f"e{i:02}", sorted({ks[i * j % 9] for j in range(i % 5)}), i % 6) for i in range(40)]
    queries = [(f"q{i}", [ks[(i + j * j) % 9] for j in range(i % 4)], i % 5) for i in range(11)]
    q = spark.createDataFrame(queries, "qid string, kmers array<string>, n int")
    got = seeds.best_seeds(q, spark.createDataFrame(entries, "id string, kmers array<string>, n int"), 3, 1, each).collect()
    assert {tuple(r) for r in got if r["pos"] <= 3} == {r for r in brute(queries, entries) if r[4]}
    if each:
        want = {r[:4] for r in brute(queries, entries, 1, each) if r[4] is None}
        assert want <= {tuple(r)[:4] for r in got if r["pos"] > 3}


def long_words(n):
    """Words of 200 letters, as texts that have lost their blanks hold."""
    return ["".join("bcdfghjklmnpqrstvwxz"[(i * i + i * j + j * j // 3) % 20] for j in range(200)) for i in range(n)]


def test_long_words_take_no_row_for_each_shared_kmer(spark, tmp_path):
    words = long_words(1200)
    spark.createDataFrame([(20, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    rows = R.QUERIES["seed_topk_all"](spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    assert {r["query"] for r in rows if r["rank"] == 1} == set(words) == {r["word"] for r in rows}


def test_round_robin_lists_no_pair_beyond_the_bands(spark, tmp_path, monkeypatch):
    """Every seeded pair used to be listed and ranked; only the best of the bands may be, with the same turns."""
    consonants = "bdfgklmnprvz"
    draw = random.Random(1)
    words = sorted({"".join(draw.choices(consonants + "aa", k=6 + i % 4)) for i in range(300)})
    spark.createDataFrame([(20, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(R.P, "seeds", None)
    monkeypatch.setattr(seeds, "ENTRIES", 50)
    rows = R.QUERIES["length_band_round_robin_all"](spark, str(tmp_path)).collect()
    bare = {w: [c for c in w if c != "a"] for w in words}
    kmers = {w: [f"{a} {b}" for a, b in zip(s, s[1:])] for w, s in bare.items()}
    want = set()
    for q in words:
        have = Counter(kmers[q])
        ranked = sorted((-sum(have[k] for k in set(kmers[w])), w) for w in words if set(kmers[w]) & set(have))
        bands = [[w for _, w in ranked[25:] if abs(len(w) - len(q)) == delta] for delta in range(3)]
        turns = sorted((i, delta, w) for delta, band in enumerate(bands) for i, w in enumerate(band))
        want |= {(q, w, delta, turn) for turn, (_, delta, w) in enumerate(turns[:25], 1)}
    assert want and {tuple(r) for r in rows} == want
