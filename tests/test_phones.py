from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.operators import align, rules


def one(spark, col, *values):
    df = spark.createDataFrame([(v,) for v in values], "w string")
    return [r[0] for r in df.select(col(F.col("w"))).collect()]


def test_phones(spark):
    got = one(spark, S.greek_phones, "λόγος", "ἄνθρωπος", "ᾠδή", "αὐτός", "εὑρίσκω", "Αἵμων", "ἄϋπνος", "ᾱ", "ᾶ", "", "x1", None)
    assert got == [
        ["l", "ó", "ɡ", "o", "s"], ["á", "n", "tʰ", "r", "ɔː", "p", "o", "s"], ["ɔː", "i", "d", "ɛ́ː"], ["au", "t", "ó", "s"], ["eu", "r", "í", "s", "k", "ɔː"],
        ["a", "h", "í", "m", "ɔː", "n"], ["á", "y", "p", "n", "o", "s"], ["aː"], ["áː"], [], [], None,
    ]


def test_shifts_and_tokens(spark):
    assert one(spark, lambda c: S.to_ipa(c, "koine"), "φίλος", "λόγος", "γῆ", "ὅδε")[0][0] == "f"
    assert one(spark, lambda c: S.to_ipa(c, "koine"), "λόγος", "γῆ") == ["lóɣos", "ɡɛ́ː"]
    assert one(spark, lambda c: S.shift_ss(F.split(c, " ")), "a s s s a", "s s", "a s a") == [["a", "t", "t", "s", "a"], ["t", "t"], ["a", "s", "a"]]
    assert one(spark, lambda c: S.tokenize(c), "tʰá las.X", "") == [["tʰ", "a", "l", "a", "s", ".", "X"], []]
    assert one(spark, lambda c: S.tokenize(c, []), "ab ɔ̃c") == [["a", "b", "ɔ̃", "c"]]


def test_transliteration_and_beta_code(spark):
    assert one(spark, S.transliterate, "ἄγγελος", "ῥήτωρ", "υἱός", "ἄϋλος", "ὁ ᾍδης", "") == ["angelos", "rhētōr", "hyios", "aylos", "ho haidēs", ""]
    assert one(spark, S.beta_to_unicode, "a)/nqrwpos", "*)aqh=nai", "lo/gos, so/s") == ["ἄνθρωπος", "Ἀθῆναι", "λόγος, σός"]


def test_keys(spark):
    assert one(spark, S.base_key, "ῬΉΤΩΡ", "ϲοφόϲ") == ["ρητωρ", "σοφος"]
    assert one(spark, S.collapse_key, "συνκαίω", "συγκέω", "ἄλλος", "ἄλος")[:2][0] == one(spark, S.collapse_key, "συγκεω")[0]
    assert len(set(one(spark, S.collapse_key, "ἄλλος", "ἄλος"))) == 1
    assert one(spark, S.query_variants, "γίγνομαι") == one(spark, S.query_variants, "γίγνομαι") and len(one(spark, S.query_variants, "λόγον")[0]) == 2
    assert one(spark, S.section_key, "4.10", "007", "12", "5a") == ["4.1", "7", "12", "5a"]
    assert one(spark, S.cited_sections, "Buck § 10.1; § 12-14, §20") == [["10.1", "20"]]


def test_centuries(spark):
    df = spark.createDataFrame([(-50, 120), (1, 100), (None, None), (101, None)], "a int, b int")
    assert [r[0] for r in df.select(S.centuries("a", "b", (-1, 1))).collect()] == [[-1, 1, 2], [1], [-1, 1], [2]]


def test_queries(spark):
    assert one(spark, S.query_mode, "abc", "abcd", "ab-c", "a. b_c") == ["Short-query", "Full-form", "Partial-form", "Short-query"]
    assert [tuple(x) if x else None for x in one(spark, S.wildcard_parts, "ab-", "-ab", "a*b", "ab")] == [("prefix", "ab", ""), ("suffix", "", "ab"), ("infix", "a", "b"), None]


def wild(spark, shape, left, right, tokens):
    df = spark.createDataFrame([(shape, left, right, tokens)], "s string, l array<string>, r array<string>, t array<string>")
    return tuple(df.select(S.wildcard_match(F.col("s"), F.col("l"), F.col("r"), F.col("t")).alias("m")).first()["m"])


def test_wildcard_match(spark):
    t = list("pateros")
    assert wild(spark, "prefix", list("pat"), [], t) == (True, 1, 3) and wild(spark, "prefix", list("pax"), [], t) == (False, 1, 2)
    assert wild(spark, "suffix", [], list("os"), t) == (True, 1, 2) and wild(spark, "suffix", [], list("xy"), t) == (False, 0, 0)
    assert wild(spark, "infix", list("at"), list("os"), t) == (True, 2, 4) and wild(spark, "infix", list("os"), list("pa"), t) == (False, 0, 0)
    assert wild(spark, "infix", list("zz"), list("os"), t) == (False, 1, 2) and wild(spark, "infix", list("at"), list("os"), []) == (False, 0, 0)


def test_infix_against_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(i, "infix", [rng.choice("ab") for _ in range(rng.randint(1, 3))], [rng.choice("ab") for _ in range(rng.randint(1, 3))], [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for i in range(200)]
    rows.append((200, "infix", ["a", "b"], ["b"], ["a"] * 5000 + ["b"] * 5000))

    def runs(f, t):
        out = []
        for i in range(len(t)):
            k = 0
            while k < len(f) and i + k < len(t) and t[i + k] == f[k]:
                k += 1
            if k:
                out.append((i, k))
        return out

    df = spark.createDataFrame(rows, "i int, s string, l array<string>, r array<string>, t array<string>")
    got = {r["i"]: tuple(r["m"]) for r in df.select("i", S.wildcard_match(F.col("s"), F.col("l"), F.col("r"), F.col("t")).alias("m")).collect()}
    assert got[200] == (True, 2, 3)
    for i, _, l, r, t in rows[:200]:  # noqa: E741
        a, b = runs(l, t), runs(r, t)
        pairs = [(x[1] == len(l) and y[1] == len(r), 2, x[1] + y[1]) for x in a for y in b if y[0] >= x[0] + x[1]]
        want = max(pairs) if pairs else (False, 0, 0) if a and b else (False, 1, max(k for _, k in a or b)) if a or b else (False, 0, 0)
        assert got[i] == want


# --- kernels against brute force --------------------------------------------------


def brute_sw(q, l, matrix, known):  # noqa: E741
    h = [[0.0] * (len(q) + 1) for _ in range(len(l) + 1)]
    best = 0.0
    for i in range(1, len(l) + 1):
        for j in range(1, len(q) + 1):
            s = 2.0 if l[i - 1] == q[j - 1] else 1 - align.phone_distance(l[i - 1], q[j - 1], matrix, known)
            h[i][j] = max(0.0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


seqs = st.lists(st.sampled_from("ptkeoX"), max_size=7)


@settings(max_examples=150, deadline=None)
@given(seqs, seqs)
def test_local_alignment_properties(q, l):  # noqa: E741
    matrix, known = {"e": {"o": 0.4}}, frozenset("ptkeo")
    score, cols = align.local_alignments([q], [l], matrix, known)[0]
    assert abs(score - brute_sw(q, l, matrix, known)) < 1e-9
    if q and l:
        assert [a for a, _ in cols if a is not None] == q and [b for _, b in cols if b is not None] == l
        assert all(a is not None or b is not None for a, b in cols)


@settings(max_examples=150, deadline=None)
@given(seqs, seqs)
def test_global_alignment_cost(q, l):  # noqa: E741
    cols = align.global_alignments([q], [l])[0]
    d = [[0.0] * (len(l) + 1) for _ in range(len(q) + 1)]
    for i in range(len(q) + 1):
        for j in range(len(l) + 1):
            if i or j:
                d[i][j] = min(([d[i - 1][j - 1] + (q[i - 1] != l[j - 1])] if i and j else []) + ([d[i - 1][j] + 1.25] if i else []) + ([d[i][j - 1] + 1.25] if j else []))
    cost = sum(1.25 if a is None or b is None else float(a != b) for a, b in cols)
    assert abs(cost - d[-1][-1]) < 1e-9 and [a for a, _ in cols if a is not None] == q and [b for _, b in cols if b is not None] == l


def test_batches_do_not_mix(spark):
    qs = [list("pten"), [], list("p"), list("kteno")]
    ls = [list("pto"), list("a"), [], list("kten")]
    together = align.local_alignments(qs, ls, {}, frozenset("ptkneo"))
    assert together == [align.local_alignments([q], [x], {}, frozenset("ptkneo"))[0] for q, x in zip(qs, ls, strict=True)]
    assert together[0] == (4.0, [("p", "p"), ("t", "t"), ("e", "o"), ("n", None)])


def test_native_distances(spark):
    df = spark.createDataFrame([(list("pten"), list("pto")), ([], []), ([], list("ab")), (list("ab"), list("ab"))], "a array<string>, b array<string>")
    inv = list("ptkneoab")
    got = df.select(align.weighted_distance(F.col("a"), F.col("b"), {}, inv), align.normalised_distance(F.col("a"), F.col("b"), {}), align.normalised_distance(F.col("a"), F.col("b"), {"e": {"o": 0.4}})).collect()
    assert [tuple(r) for r in got] == [(6.0, 0.5, 0.35), (0.0, 0.0, 0.0), (10.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


# --- rules ------------------------------------------------------------------------


def explained(columns, raw, lemma=None):
    return [(a["rule_id"], a["position"]) for a in rules.explain(columns, rules.compile_rules(raw), lemma)]


def cols(q, l):  # noqa: E741
    return [(a if a != "-" else None, b if b != "-" else None) for a, b in zip(q.split(), l.split(), strict=True)]


def test_observed_differences():
    assert explained(cols("p t -  e", "k t n -"), []) == [("OBS-SUB", 0), ("OBS-DEL", 2), ("OBS-INS", 3)]


def test_longest_and_contextual_rules_first():
    raw = [{"id": "A", "input": "k", "output": "p"}, {"id": "B", "input": "kt", "output": "pp"}, {"id": "C", "input": "k", "output": "p", "context": "V_V"}]
    assert explained(cols("p p", "k t"), raw) == [("B", 0)]
    assert explained(cols("a p a", "a k a"), raw) == [("C", 1)]


def test_contexts():
    rule = lambda ctx, **k: [{"id": "R", "input": "s", "output": "t", "context": ctx} | k]
    assert explained(cols("a t", "a s"), rule("_#")) == [("R", 1)] and explained(cols("t a", "s a"), rule("_#")) == [("OBS-SUB", 0)]
    assert explained(cols("t a", "s a"), rule("#_V")) == [("R", 0)] and explained(cols("t m k", "s m k"), rule("_NC")) == [("R", 0)]
    assert explained(cols("e t", "e s"), rule("after e, i, or r")) == [("R", 1)] and explained(cols("a t", "a s"), rule("all environments except after e, i, or r")) == [("R", 1)]
    assert explained(cols("t k", "s k"), rule("_{k,p}")) == [("R", 0)] and explained(cols("t a k p", "s a k p"), rule("_...kp")) == [("R", 0)]
    assert explained(cols("t", "s"), rule("nonsense")) == [("OBS-SUB", 0)] and explained(cols("t", "s"), rule(None)) == [("R", 0)]


def test_insertion_deletion_tolerance_constraints():
    assert explained(cols("a i a", "a - a"), [{"id": "I", "input": "", "output": "i"}]) == [("OBS-INS", 1)]
    assert explained(cols("a i a", "a - a"), [{"id": "I", "input": "", "output": "i", "is_insertion": True}]) == [("I", 1)]
    assert explained(cols("a -", "a n"), [{"id": "D", "input": "n", "output": "", "context": "_#"}]) == [("D", 1)]
    assert explained(cols("e", "a"), [{"id": "L", "input": "aː", "output": "e"}]) == [("L", 0)]
    assert explained(cols("e", "aː"), [{"id": "L", "input": "a", "output": "e"}]) == [("OBS-SUB", 0)]
    c = [{"id": "K", "input": "s", "output": "t", "lemma_constraints": {"pos": ["noun", "verb"]}}]
    assert explained(cols("t", "s"), c) == [("OBS-SUB", 0)] and explained(cols("t", "s"), c, {"pos": "verb"}) == [("K", 0)]


def test_word_final_suffix_may_start_before_the_run():
    raw = [{"id": "S", "input": "os", "output": "on", "context": "_#"}]
    assert explained(cols("l o n", "l o s"), raw) == [("S", 1)]


def test_strict_before_tolerant():
    raw = [{"id": "LONG", "input": "aːs", "output": "et"}, {"id": "SHORT", "input": "a", "output": "e"}]
    assert explained(cols("e t", "a s"), raw)[0] == ("SHORT", 0)
