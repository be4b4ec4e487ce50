import random
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import splits
from lexiloom.session import Scratch

REC = "record_id long, source_file string, tm_id string"


def groups(spark, rows):
    df = spark.createDataFrame(rows, REC)
    comps = splits.components(splits.edges(df), Scratch(spark, "test"))
    return {r["record_id"]: r["component"] for r in splits.component_of(df, comps, "source_file", "tm_id").collect()}


def test_ties(spark):
    rows = [
        (1, "a/1.xml", "TM 5"), (2, "A 1 XML", None), (3, "b.xml", "05 + 9"), (4, "c.xml", "9"), (5, "d.xml", "n/a"), (6, "e.xml", "0"),
        (7, "g.xml", "000"), (8, None, "9"), (9, None, None), (10, "h.xml", ""),
    ]
    g = groups(spark, rows)
    assert g[1] == g[2] == g[3] == g[4] == g[8]
    assert len({g[i] for i in (1, 5, 6, 7, 10)}) == 5 and g[9] is None


def test_long_chain_and_random_graph(spark):
    rng = random.Random(3)
    rows = [(i, f"f{i}", f"{i + 1} {i + 2}") for i in range(300)]
    rows += [(1000 + i, f"g{rng.randint(0, 150)}", str(10_000 + rng.randint(0, 150))) for i in range(200)]
    got = groups(spark, rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, f, t in rows:
        for n in t.split():
            parent[find("f" + f)] = find("t" + n)
    want = defaultdict(set)
    have = defaultdict(set)
    for i, f, _ in rows:
        want[find("f" + f)].add(i)
        have[got[i]].add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


@pytest.mark.parametrize("paired", [1, 1000])
def test_pairs_across_splits(spark, monkeypatch, paired):
    monkeypatch.setattr(splits, "PAIRED_ROWS", paired)
    recs = spark.createDataFrame([(1, "a", "5"), (2, "b", "5"), (3, "c", "6")], REC)
    comps = splits.components(splits.edges(recs), Scratch(spark, "test"))
    res = spark.createDataFrame(
        [(1, "a", "train"), (2, "b", " TEST"), (3, "A.", "Train "), (4, "c", "dev"), (5, "c", None), (6, "c", "dev"), (7, None, "test"), (8, "zz", "dev"), (9, "z z", "test")],
        "result_id long, source_file string, split string",
    )
    got = {(r["a"], r["b"]) for r in splits.tied_across_splits(res, comps, "result_id", "source_file", "split", Scratch(spark, "test")).collect()}
    assert got == {(1, 2), (2, 3), (8, 9)}


def test_shares_and_balance(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", rng.choice("xyz"), rng.randint(1, 4)) for i in range(3000)] + [("big", "x", 2500)]
    sized = spark.createDataFrame(rows, "component string, label string, n long")
    placed = {r["component"]: r["split"] for r in splits.assign_splits(sized, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(placed) == {c for c, _, _ in rows}
    n = Counter()
    for c, lab, k in rows:
        n[placed[c], lab] += k
        n[placed[c]] += k
    total = sum(k for _, _, k in rows)
    assert abs(n["train"] / total - 0.8) < 0.02 and abs(n["test"] / total - 0.1) < 0.02
    for lab in "yz":
        assert abs(n["test", lab] / sum(n[s, lab] for s in ("train", "validation", "test")) - 0.1) < 0.04
    assert placed["big"] == "train"


def test_rare_labels_are_balanced_too(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_LABELS", 5)
    monkeypatch.setattr(splits, "RARE", 3)
    rows = [(f"c{i}", f"l{i % 40}", 1) for i in range(4000)] + [("x", None, 3)]
    placed = {r["component"]: r["split"] for r in splits.assign_splits(spark.createDataFrame(rows, "component string, label string, n long"), {"train": 0.5, "test": 0.5}).collect()}
    assert len(placed) == 4001
    n = Counter((lab, placed[c]) for c, lab, _ in rows)
    assert all(abs(n[f"l{k}", "train"] - 50) <= 15 for k in range(40)) and abs(sum(v == "train" for v in placed.values()) - 2000) < 40


def test_empty(spark):
    empty = spark.createDataFrame([], REC)
    comps = splits.components(splits.edges(empty), Scratch(spark, "test"))
    assert comps.count() == 0
    assert splits.assign_splits(spark.createDataFrame([], "component string, label string, n long"), {"train": 1.0}).count() == 0


def test_long_chain_in_any_order_takes_few_rounds(spark, monkeypatch):
    rounds = []
    counted = Scratch.write_counted
    monkeypatch.setattr(Scratch, "write_counted", lambda self, df, name, condition: rounds.append(name) or counted(self, df, name, condition))
    rows = [(i, f"f{i}", f"{i + 1} {i + 2}") for i in range(3000)]
    random.Random(5).shuffle(rows)
    g = groups(spark, rows)
    assert len(set(g.values())) == 1 and len(rounds) < 20
