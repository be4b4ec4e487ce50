import os

import pytest

from lexiloom.llm import chunking, mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no tokenizer here")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding()


TEXTS = ["x" * 20_000, "ῷ" * 9_000, " " * 30_000, "a\n\n" * 9_000, "😀" * 5_000, "αβγ δε. " * 3_000, "# Head\nword word.\n\n" * 900, "Satz, der endet; noch einer. " * 800]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(2048, 128), (64, 8)])
def test_round_trip_and_limit(enc, text, limit, overlap):
    text = text if limit > 100 else text[:3000]
    got = chunking.cut(text, enc, limit, overlap)
    assert "".join(text[new:e] for _, new, e, _ in got) == text
    assert all(size <= limit and size == len(enc.encode_ordinary(text[a:e])) for a, _, e, size in got)
    for (_, _, end, _), (a, new, _, _) in zip(got, got[1:], strict=False):
        assert new == end and a < new


def test_overlap_is_the_last_tokens(enc):
    text = "plain words here and there. " * 2_000
    got = chunking.cut(text, enc)
    for (_, _, end, _), (a, new, _, _) in zip(got, got[1:], strict=False):
        assert 128 <= len(enc.encode_ordinary(text[a:new])) <= 131 and text[end - 1] == "."


def test_short_and_empty(enc):
    assert chunking.cut("", enc) == []
    assert chunking.cut("short", enc) == [(0, 0, 5, len(enc.encode_ordinary("short")))]


def test_segments_do_not_change_tokens(enc, monkeypatch):
    text = ("Word,  two\n\n three 'll γλῶσσα  \t x" * 300) + "   "
    whole = enc.encode_ordinary(text)
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    assert tokens.encode(enc, text) == whole


def test_pieces_table(spark, enc):
    long = "word one two. " * 1_500
    df = spark.createDataFrame([(1, long, "x"), (2, "short", "y"), (3, None, "z"), (4, "", "z"), (1, long, "x")], "doc_id long, text string, piece string")
    got = chunking.pieces(df).collect()
    assert {r["doc_id"] for r in got} == {1} and all(r["n_tokens"] <= 2048 for r in got)
    assert chunking.pieces(df.limit(0)).count() == 0


def test_mix(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(10_000 + i, "b", 10) for i in range(100)] + [(20_000 + i, "c", 5) for i in range(50)] + [(1, None, 7), (None, "a", 0)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1, "k"), ("b", 0.4, 3, "k"), ("gone", 0.1, 2, "k")], "source string, target_share double, max_repeats int, tokens string")
    exact = mixing.exact_budget(counted, targets)
    assert exact == pytest.approx(3000 * 9 / 4)
    rep = {r["source"]: r for r in mixing.shares(mixing.mix(counted, targets, budget=exact), counted, targets, exact).collect()}
    assert set(rep) == {"a", "b", "gone"}
    # b is the scarce one: 1,000 tokens, at most three times
    assert rep["b"]["rate"] == pytest.approx(3.0) and rep["b"]["used_tokens"] == 3000 and rep["b"]["most_repeats"] == 3
    assert rep["a"]["most_repeats"] == 1 and abs(rep["a"]["actual_share"] - 5 / 9) < 0.03 and rep["gone"]["used"] == 0
    again = mixing.mix(counted.repartition(5), targets).groupBy("doc_id").count().orderBy("doc_id").collect()
    assert again == mixing.mix(counted, targets).groupBy("doc_id").count().orderBy("doc_id").collect()


def test_mix_fills_the_budget(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(10_000 + i, "b", 10) for i in range(100)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in mixing.rates(counted, targets).collect()}
    # of 11,000 tokens b can give 3,000 only; a gives what it leaves
    assert rep["b"]["rate"] == 3.0 and rep["a"]["rate"] == pytest.approx(0.8) and rep["a"]["reachable"] == pytest.approx(8 / 11)
    for budget, a, b in ((0.0, 0, 0), (1_000.0, 0.05, 0.5), (6_000.0, 0.3, 3.0), (23_000.0, 2.0, 3.0), (1e9, 2.0, 3.0)):
        rep = {r["source"]: r["rate"] for r in mixing.rates(counted, targets, budget).collect()}
        assert (rep["a"], rep["b"]) == (pytest.approx(a), pytest.approx(b))


def test_mix_is_the_same_by_shuffle(spark, monkeypatch):
    docs = [(i, "ab"[i % 2], i % 7) for i in range(300)] + [(None, "a", None)]
    counted = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 3)], "source string, target_share double, max_repeats int")
    want = sorted(map(str, mixing.mix(counted, targets).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_TARGETS", 1)
    assert sorted(map(str, mixing.mix(counted, targets).collect())) == want


def test_mix_of_nothing(spark):
    counted = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert mixing.mix(counted, targets).count() == 0
    assert mixing.shares(mixing.mix(counted, targets), counted, targets).first()["rate"] == 0.0


def test_token_counts(spark, enc):
    df = spark.createDataFrame([(1, "a", "two words"), (2, None, None), (3, "b", "")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.counted(df).collect()}
    assert got == {1: len(enc.encode_ordinary("two words")), 2: 0, 3: 0}
