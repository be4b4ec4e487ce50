import random

import pytest

from lexiloom.operators import hierarchy as H

SCHEMA = "row_id long, id string, parent string, loaded_at int, dialect_group string, w string"


def run(spark, rows):
    df = spark.createDataFrame([(i, a, p, t, g, "clash") for i, (a, p, t, g) in enumerate(rows)], SCHEMA)
    links, nodes, rings = H.hierarchy(df)
    return (
        {(r[0], r[1]): r[2] for r in H.ancestor_pairs(nodes, rings).collect()},
        {r["id"]: r for r in H.described(links, nodes).collect()},
        {r["v"] for r in rings.collect()},
    )


def brute(parent):
    out = {}
    for v in parent:
        x, n, seen = parent[v], 0, set()
        while x is not None and x not in seen:
            seen.add(x)
            n += 1
            out[x, v] = n
            x = parent[x]
    return out


def test_chain_and_writing(spark):
    rows = [("a", None, 1, "g"), (" B", "A ", 1, None), ("c", "b", 1, "h"), ("d", "nowhere", 1, None), ("e", " ", 1, None), (None, "a", 1, None), ("  ", "a", 1, None)]
    pairs, about, ring = run(spark, rows)
    assert pairs == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 2} and not ring
    assert (about["c"]["root"], about["c"]["depth"], about["c"]["path"], about["c"]["root_label"]) == ("a", 2, "a/b/c", "g")
    assert about["d"]["depth"] == 0 and about["e"]["root"] == "e" and len(about) == 5


def test_latest_row_holds_and_ties(spark):
    rows = [("a", None, 1, None), ("b", None, 1, None), ("x", "a", 1, None), ("x", "b", 2, None), ("y", "a", 5, None), ("y", "b", 5, None), ("y", None, None, None)]
    pairs, _, _ = run(spark, rows)
    assert pairs == {("b", "x"): 1, ("b", "y"): 1}


def test_rings(spark):
    rows = [("s", "s", 1, None), ("t", "s", 1, None), ("p", "q", 1, None), ("q", "r", 1, None), ("r", "p", 1, None), ("u", "q", 1, None), ("v", "u", 1, None), ("w", "u", 1, None)]
    pairs, about, ring = run(spark, rows)
    assert pairs == brute({a: p for a, p, _, _ in rows})
    assert ring == {"s", "p", "q", "r"}
    assert about["v"]["root"] is None and about["v"]["cycle_entry"] == "q" and about["q"]["on_cycle"] and not about["u"]["on_cycle"]


@pytest.mark.parametrize("finish,cell", [(0, 1000), (0, 7), (100, 3), (4096, 1000)])
def test_random_forest_with_rings_and_long_chain(spark, monkeypatch, finish, cell):
    monkeypatch.setattr(H, "FINISH", finish)
    monkeypatch.setattr(H, "RING_CELL", cell)
    rng = random.Random(4)
    parent = {f"n{i}": (f"n{rng.randrange(150)}" if rng.random() < 0.9 else None) for i in range(150)}
    parent.update({f"r{i}": f"r{(i + 1) % 25}" for i in range(25)})
    parent.update({f"k{i}": f"k{i + 1}" if i < 119 else None for i in range(120)})
    pairs, about, _ = run(spark, [(v, p, 1, None) for v, p in parent.items()])
    assert pairs == brute(parent)
    assert about["k0"]["depth"] == 119 and about["k0"]["root"] == "k119"


def test_empty(spark):
    pairs, about, ring = run(spark, [])
    assert not pairs and not about and not ring
