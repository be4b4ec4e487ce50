import random
import re

import numpy as np

from lexiloom.llm import leakage
from lexiloom.llm import words as W
from lexiloom.llm.fmindex import FMIndex, suffix_array


def test_suffix_array_and_search_against_brute_force():
    rng = np.random.default_rng(5)
    for n, sigma in ((1, 2), (50, 3), (400, 5), (300, 40)):
        seq = rng.integers(0, sigma, n)
        assert [tuple(seq[i:]) for i in suffix_array(seq)] == sorted(tuple(seq[i:]) for i in range(n))
        index = FMIndex.build(seq, sigma)
        index = FMIndex.load(index.n, **index.parts())
        phrases = np.array([seq[i : i + 3] if n >= 3 and rng.random() < 0.7 else rng.integers(0, sigma, 3) for i in rng.integers(0, max(1, n - 2), 30)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(n - 2) if (seq[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def words_of(text):
    return re.findall(r"[^\W_]+", W.fold(text))


def test_suffix_array_of_repeats():
    for seq in ([3] * 500, [1, 2, 3] * 200, [5, 0, 5, 0, 5], []):
        assert suffix_array(np.array(seq, np.int64)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


ODD = "aİeſΣςΆ̧́̈ͅ 1각가각Åक़̈́ΩﬀཱཱིིောေဦÅ\U00011131\U00011127゙か"


def test_words_and_places(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", "x" * 50, "one two\n" * 30]
    for chunk in (10**6, 7):
        monkeypatch.setattr(W, "CHUNK", chunk)
        got: dict = {}
        for number, start, end, owner in W.words(texts):
            for n, a, b, k in zip(number.tolist(), start.tolist(), end.tolist(), owner.tolist(), strict=True):
                got.setdefault(k, []).append((n, texts[k][a:b]))
        names: dict = {}
        for k, t in enumerate(texts):
            want = words_of(t or "")
            have = got.get(k, [])
            assert len(want) == len(have)
            for w, (n, raw) in zip(want, have, strict=True):
                assert w in W.fold(raw) and names.setdefault(w, n) == n
        assert len(set(names.values())) == len(names)


WORDS = ["alpha", "beta", "gamma", "delta", "Λόγος", "x1", "42", "rho"]


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.randint(3, 20))) for i in range(12)] + [(98, None), (99, "short")]
    docs = []
    for d in range(60):
        t = say(rng.randint(0, 30))
        if rng.random() < 0.5:
            w = items[rng.randrange(12)][1].split()
            k = rng.randint(0, max(0, len(w) - 4))
            t += ", stop; " + " - ".join(w[k : k + rng.randint(3, 9)]).upper() + "! " + say(5)
        docs.append((d, t))
    docs += [(200, None), (201, ""), (202, items[0][1] + " other"), (203, items[0][1] + " other")]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(items, "item_id long, text string")
    for shard in (10**6, 40):
        monkeypatch.setattr(leakage, "SHARD_WORDS", shard)
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(ddf, idf, words=5).collect()}
        assert got == brute(docs, items, 5) and got
    index = leakage.build_index(ddf, "doc_id", "text").cache()
    for part in (idf.where("item_id < 6"), idf.where("item_id >= 6")):  # one index, two sets of items
        some = [(r[0], r[1]) for r in part.collect()]
        assert {(r[0], r[1]) for r in leakage.search(index, part, words=5).collect()} == brute(docs, some, 5)
    monkeypatch.setattr(leakage, "MAX_ITEM_BYTES", 200)
    assert {(r[0], r[1]) for r in leakage.leaks(ddf, idf, words=5).select("doc_id", "item_id").collect()} == brute(docs, items, 5)


def test_spans_cover_the_words(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    text = "Intro. " + item.upper().replace(" ", ",\n") + " after " + item[:-9]
    rows = leakage.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    spans = [text[s["start"] : s["end"]] for r in rows for s in r["spans"]]
    assert [words_of(s) for s in spans] == [item.split(), item.split()[:12]]


def test_spans_where_folding_moves_words(spark):
    item = "İzmir İstanbul İnci one two three four five six seven eight nine"
    tail = "twelve tail words here"
    texts = [item + " " + tail, "x̲y ́ ﬁsh " + item + " " + tail, item.replace("e", "é") + tail, item.upper() + " " + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {0: [item], 1: [item], 3: [item.upper() + " " + item]}


def test_items_repeat_and_clash(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, item, 5), (1, item, 6), (2, f"{item} {item}", None)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(3, item, "x"), (4, item, "y"), (5, "", None)], "item_id long, text string, doc_id string")
    rows = sorted((r[0], r[1], len(r[2])) for r in leakage.leaks(docs, items).collect())
    assert rows == [(1, 3, 1), (1, 3, 1), (1, 4, 1), (1, 4, 1), (2, 3, 1), (2, 4, 1)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert leakage.leaks(d, i).count() == 0
    assert leakage.leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), i).count() == 0


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    text = "filler " * 200_000 + item + " end"
    got = leakage.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 3)]
    assert text[got[0]["spans"][0]["start"] : got[0]["spans"][0]["end"]] == item
