import random

import numpy as np
import pytest

from lexiloom.llm import dedup
from lexiloom.llm.queries_dedup import parsed_lines

ROWS = [
    (1, "Λόγος", "λόγος", "p.a/1.xml", 1),
    (2, " λόγοσ ", "ΛΌΓΟΣ.", "P A 1 XML", 1),
    (3, "λόγος", "λόγος", "p.a/1.xml", 2),
    (4, "λογος", "λόγος", "p.a/1.xml", 1),
    (5, "λόγος", "(λόγος)", "p.a/1.xml", 1),
    (6, "x", None, "f", 1),
    (7, "X", None, "F", 1),
    (8, "x", "", "f", 1),
    (9, None, None, None, None),
    (10, None, None, None, None),
    (11, "ῷ", "ß", "f", 3),  # an iota beside a letter, or ss, is another reading
    (12, "Ω\u0342Ι", "SS", "f", 3),
]
SCHEMA = "record_id long, original string, regularized string, source_file string, pair_index int"


def pairs(df):
    return {(r[0], r[1]) for r in dedup.Repeats(df, "record_id", ["original", "regularized", "source_file"], ["pair_index"]).pairs().collect()}


def test_formatting_does_not_count(spark):
    assert pairs(spark.createDataFrame(ROWS, SCHEMA)) == {(1, 2), (1, 5), (6, 7), (9, 10)}


def test_empty_table(spark):
    assert pairs(spark.createDataFrame([], SCHEMA)) == set()


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force_with_hot_group(spark, parts, monkeypatch):
    monkeypatch.setattr(dedup, "MIN_HOT_ROWS", 50)
    rng = random.Random(parts)
    rows = [(i, "hot" if i % 3 == 0 else f"w{rng.randint(0, 600)}", "r", "f", 1) for i in range(1500)]
    got = pairs(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    first, want = {}, set()
    for i, o, *_ in rows:
        if o in first:
            want.add((first[o], i))
        first.setdefault(o, i)
    assert got == want


def test_collapsed_counts_everything(spark):
    rows = [(i, f"w{i % 40}", "r", "f", 1) for i in range(100)] + [(1000 + i, f"alone{i}", "r", "f", 1) for i in range(30)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], SCHEMA + ", n_copies string").drop("n_copies")
    out = dedup.Repeats(df, "record_id", ["original", "regularized", "source_file"], ["pair_index"], ["original"]).collapsed().collect()
    assert len(out) == 70 and sum(r["n_copies"] for r in out) == 130
    assert {r["_id"] for r in out if r["n_copies"] > 1} == set(range(40))


@pytest.mark.parametrize("sent,segments", [(1 << 18, 1 << 14), (1 << 19, 2), (1 << 30, 2)])
def test_folded_filter_of_bounded_size(spark, monkeypatch, sent, segments):
    monkeypatch.setattr(dedup, "MAX_SENT_BITS", sent)
    monkeypatch.setattr(dedup, "MAX_SEGMENTS", segments)
    rows = [(i, f"w{i % 90_000}" if i < 120_000 else f"alone{i}", "r", "f", 1) for i in range(150_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = dedup.Repeats(df, "record_id", ["original", "regularized", "source_file"], ["pair_index"], ["original"])
    assert {(r[0], r[1]) for r in found.pairs().collect()} == {(i, i + 90_000) for i in range(30_000)}
    out = found.collapsed()
    assert out.count() == 120_000 and out.where("n_copies = 2").count() == 30_000
    if sent == 1 << 30:  # all in proportion: next to no singleton is shuffled
        assert found.split.where("_maybe").count() < 61_000


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "x " * 300_000, "a", "f", 1, "k"), (2, "X-" * 300_000, "A", "F", 1, "k"), (3, "", "", "", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", n string")
    assert pairs(df) == {(1, 2)}


def test_a_full_filter_loses_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BITS_PER_RECORD", 1)
    rows = [(i, f"w{i % 200_000}", "r", "f", 1) for i in range(250_000)]
    assert len(pairs(spark.createDataFrame(rows, SCHEMA).repartition(4))) == 50_000


def test_positions_stay_inside():
    p = dedup.positions(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 1000), 1 << 18)
    assert p.max() < 1 << 18 and (p // dedup.BLOCK_BITS == (p // dedup.BLOCK_BITS)[:, :1]).all()


def test_lines_in_any_writing(spark):
    lines = [
        (1, '{"original":"a","regularized":"b","source_file":"f","pair_index":"7"}'),
        (2, '{ "pair_index" : 7.0, "original" : "\\u0061", "regularized":"b","source_file":"f","tm_id":5}'),
        (3, "{broken"),
        (4, None),
    ]
    got = {r["record_id"]: (r["original"], r["pair_index"]) for r in parsed_lines(spark.createDataFrame(lines, "record_id long, line string")).collect()}
    assert got == {1: ("a", 7), 2: ("a", 7), 3: (None, None), 4: (None, None)}
