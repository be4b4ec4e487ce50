"""Alignment kernels.

Weighted edit distances are native: a row of the distance table is an array, folded over
the tokens by nested ``aggregate`` calls.  Alignments with traceback run in Arrow batches:
the tables of all pairs of a batch are filled together, cell by cell, with numpy.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two cost models.
GAP_RAW, UNKNOWN, KNOWN = 5.0, 5.0, 1.0
GAP_NORMALISED = 1.0
SW_MATCH, SW_GAP = 2.0, -1.0
NW_MATCH, NW_MISMATCH, NW_GAP = 0.0, 1.0, 1.25
#: Pairs whose tables are filled together.
CHUNK = 2048

Matrix = dict[str, dict[str, float]]

ALIGNMENT = "array<struct<q:string,l:string>>"


def bare(phone: str) -> str:
    """The phone without accent marks."""
    d = unicodedata.normalize("NFD", phone)
    return unicodedata.normalize("NFC", "".join(c for c in d if c not in "̀́̂͂"))


def phone_distance(a: str, b: str, matrix: Matrix, inventory: frozenset[str]) -> float:
    """0 if equal, the matrix' value in either direction, 1 for known phones, else 5."""
    a, b = bare(a), bare(b)
    if a == b:
        return 0.0
    found = matrix.get(a, {}).get(b, matrix.get(b, {}).get(a))
    if found is not None:
        return float(found)
    return KNOWN if a in inventory and b in inventory else UNKNOWN


# --- native distances -----------------------------------------------------------


def matrix_column(matrix: Matrix) -> Column:
    """The matrix as one literal map from ``a b`` to the cost; absent pairs are absent."""
    flat = {}
    for a, row in matrix.items():
        for b, v in row.items():
            flat[f"{a} {b}"] = float(v)
    for a, row in matrix.items():
        for b, v in row.items():
            flat.setdefault(f"{b} {a}", float(v))
    if not flat:
        return F.expr("cast(map() as map<string,double>)")
    return F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])


def _table(a: Column, b: Column, cost, gap: float) -> Column:
    """The last cell of the distance table; the two sides are bound first, so that they are computed once a pair.

    Equal tokens at both ends cost nothing in a best path, as gaps cost the same anywhere: only what
    lies between them is filled in, so near pairs of long words take little.
    """
    one = lambda x, body: F.element_at(F.transform(F.array(x), body), 1)
    equal = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True))), F.lit(True)) - 1

    def middle(s: Column) -> Column:
        k = equal(s["a"], s["b"]).cast("int")
        tail = lambda c: F.slice(s[c], k + 1, F.greatest(F.size(s[c]) - k, F.lit(0)))
        return F.when(k < 0, F.lit(0.0)).otherwise(one(F.struct(tail("a").alias("a"), tail("b").alias("b")), inner))

    def inner(s: Column) -> Column:
        k = F.least(equal(F.reverse(s["a"]), F.reverse(s["b"])).cast("int"), F.size(s["a"]), F.size(s["b"]))
        head = lambda c: F.slice(s[c], F.lit(1), F.size(s[c]) - k)
        return one(F.struct(head("a").alias("a"), head("b").alias("b")), lambda t: _last_cell(t["a"], t["b"], cost, gap))

    return one(F.struct(a.alias("a"), b.alias("b")), middle)


def _last_cell(a: Column, b: Column, cost, gap: float) -> Column:
    n = F.size(b)
    first = F.transform(F.sequence(F.lit(0), n), lambda j: j * F.lit(gap))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.element_at(prev, 1) + F.lit(gap))

        def cell(acc: Column, j: Column) -> Column:
            best = F.least(
                F.element_at(prev, j) + cost(x, F.element_at(b, j)),
                F.element_at(prev, j + 1) + F.lit(gap),
                F.element_at(acc, j) + F.lit(gap),
            )
            return F.concat(acc, F.array(best))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, cell)).otherwise(start)

    return F.element_at(F.aggregate(a, first, row), -1)


def weighted_distance(a: Column, b: Column, matrix: Matrix, inventory: list[str]) -> Column:
    """Global edit distance with gap 5 and phone distances as substitutions."""
    costs = matrix_column(matrix)

    def cost(x: Column, y: Column) -> Column:
        known = x.isin(list(inventory)) & y.isin(list(inventory))
        return F.when(x == y, 0.0).otherwise(F.coalesce(F.element_at(costs, F.concat_ws(" ", x, y)), F.when(known, KNOWN).otherwise(UNKNOWN)))

    return _table(a, b, cost, GAP_RAW)


def normalised_distance(a: Column, b: Column, matrix: Matrix) -> Column:
    """Edit distance with unit gaps and capped substitutions over the longer length, in 0..1; 0 for two empties."""
    costs = matrix_column(matrix)

    def cost(x: Column, y: Column) -> Column:
        return F.when(x == y, 0.0).otherwise(F.least(F.coalesce(F.element_at(costs, F.concat_ws(" ", x, y)), F.lit(1.0)), F.lit(1.0)))

    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _table(a, b, cost, GAP_NORMALISED) / longest)))


# --- batched alignment ----------------------------------------------------------


def _codes(qs: list, ls: list) -> tuple[np.ndarray, np.ndarray, list[str]]:
    number: dict[str, int] = {}
    rows = []
    for seqs in (qs, ls):
        out = np.full((len(seqs), max((len(s) for s in seqs), default=0)), -1, np.int64)
        for i, s in enumerate(seqs):
            for j, t in enumerate(s):
                out[i, j] = number.setdefault(t, len(number))
        rows.append(out)
    return rows[0], rows[1], list(number)


def _edge(q: list, l: list, left: bool) -> list[tuple]:  # noqa: E741
    """What lies outside the core: equal outer run kept, the rest set against the core."""
    if not left:
        q, l = q[::-1], l[::-1]  # noqa: E741
    k = 0
    while k < min(len(q), len(l)) and q[k] == l[k]:
        k += 1
    m = max(len(q), len(l))
    pad = lambda s: s[:k] + [None] * (m - len(s)) + s[k:]
    cols = list(zip(pad(q), pad(l), strict=True))
    return cols if left else cols[::-1]


def local_alignments(qs: list[list[str]], ls: list[list[str]], matrix: Matrix, inventory: frozenset[str]) -> list[tuple[float, list[tuple]]]:
    """Best local alignment of each pair, extended over both edges: (score, columns of (query, lemma)).

    The first strictly greater cell in row-major order (rows are the lemma) ends the core;
    ties go diagonal, then up, then left.
    """
    out: list[tuple[float, list[tuple]]] = []
    for at in range(0, len(qs), CHUNK):
        out += _local_chunk(qs[at : at + CHUNK], ls[at : at + CHUNK], matrix, inventory)
    return out


def _local_chunk(qs: list, ls: list, matrix: Matrix, inventory: frozenset[str]) -> list:
    q, l, names = _codes(qs, ls)  # noqa: E741
    b, n, m = len(qs), q.shape[1], l.shape[1]
    score = np.array([[SW_MATCH if x == y else 1.0 - phone_distance(y, x, matrix, inventory) for x in names] for y in names]).reshape(len(names), len(names))
    h = np.zeros((m + 1, n + 1, b))
    way = np.zeros((m + 1, n + 1, b), np.int8)
    best, best_r, best_c = np.zeros(b), np.zeros(b, int), np.zeros(b, int)
    close = lambda x, y: np.abs(x - y) <= np.maximum(1e-9 * np.maximum(np.abs(x), np.abs(y)), 1e-9)
    for r in range(1, m + 1):
        row_on = l[:, r - 1] >= 0
        for c in range(1, n + 1):
            on = row_on & (q[:, c - 1] >= 0)
            diag = h[r - 1, c - 1] + score[l[:, r - 1], q[:, c - 1]]
            up, left = h[r - 1, c] + SW_GAP, h[r, c - 1] + SW_GAP
            cell = np.where(on, np.maximum(np.maximum(diag, up), np.maximum(left, 0.0)), 0.0)
            h[r, c] = cell
            way[r, c] = np.where(cell == 0, 0, np.where(close(cell, diag), 1, np.where(close(cell, up), 2, 3)))
            more = cell > best
            best[more], best_r[more], best_c[more] = cell[more], r, c
    out = []
    for i in range(b):
        qi, li = list(qs[i]), list(ls[i])
        if not qi or not li:
            out.append((0.0, []))
            continue
        r, c = int(best_r[i]), int(best_c[i])
        tail = _edge(qi[c:], li[r:], left=False)
        core = []
        while r > 0 and c > 0 and way[r, c, i]:
            w = way[r, c, i]
            core.append((qi[c - 1] if w != 2 else None, li[r - 1] if w != 3 else None))
            r, c = r - (w != 3), c - (w != 2)
        out.append((float(best[i]), _edge(qi[:c], li[:r], left=True) + core[::-1] + tail))
    return out


def global_alignments(qs: list[list[str]], ls: list[list[str]]) -> list[list[tuple]]:
    """Identity alignment of each pair with match 0, mismatch 1, gap 1.25; ties go diagonal, then up."""
    out: list[list[tuple]] = []
    for at in range(0, len(qs), CHUNK):
        qc, lc = qs[at : at + CHUNK], ls[at : at + CHUNK]
        q, l, _ = _codes(qc, lc)  # noqa: E741
        b, m, n = len(qc), q.shape[1], l.shape[1]
        d = np.zeros((m + 1, n + 1, b))
        d[:, 0], d[0, :] = (np.arange(m + 1) * NW_GAP)[:, None], (np.arange(n + 1) * NW_GAP)[:, None]
        way = np.zeros((m + 1, n + 1, b), np.int8)
        for r in range(1, m + 1):
            for c in range(1, n + 1):
                diag = d[r - 1, c - 1] + np.where(q[:, r - 1] == l[:, c - 1], NW_MATCH, NW_MISMATCH)
                up, left = d[r - 1, c] + NW_GAP, d[r, c - 1] + NW_GAP
                cell = np.minimum(diag, np.minimum(up, left))
                d[r, c] = cell
                way[r, c] = np.where(cell == diag, 1, np.where(cell == up, 2, 3))
        for i in range(b):
            qi, li, cols = list(qc[i]), list(lc[i]), []
            r, c = len(qi), len(li)
            while r or c:
                w = way[r, c, i] if r and c else (2 if r else 3)
                cols.append((qi[r - 1] if w != 3 else None, li[c - 1] if w != 2 else None))
                r, c = r - (w != 3), c - (w != 2)
            out.append(cols[::-1])
    return out


def local_alignment_udf(matrix: Matrix, inventory: list[str]):
    """(query tokens, lemma tokens) -> STRUCT<score, alignment>."""
    known = frozenset(inventory)

    @F.pandas_udf(f"struct<score:double,alignment:{ALIGNMENT}>")
    def align(q: pd.Series, l: pd.Series) -> pd.DataFrame:  # noqa: E741
        got = local_alignments([list(x) if x is not None else [] for x in q], [list(x) if x is not None else [] for x in l], matrix, known)
        return pd.DataFrame({"score": [s for s, _ in got], "alignment": [[{"q": a, "l": b} for a, b in cols] for _, cols in got]})

    return align


def global_alignment_udf():
    """(tokens, tokens) -> ARRAY<STRUCT<q, l>>."""

    @F.pandas_udf(ALIGNMENT)
    def align(q: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        got = global_alignments([list(x) if x is not None else [] for x in q], [list(x) if x is not None else [] for x in l])
        return pd.Series([[{"q": a, "l": b} for a, b in cols] for cols in got])

    return align


def confidence(score: Column, q: Column, l: Column) -> Column:  # noqa: E741
    """Score over twice the longer length, in 0..1; equal sequences give 1."""
    longest = F.greatest(F.size(q), F.size(l), F.lit(1))
    return F.when(q == l, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / (2.0 * longest))))


def closest_form(forms: Column, key: Column, form_key, marks) -> Column:
    """Of an array of forms the one with the nearest key, then most accents, then first; null for none."""
    ranked = F.transform(forms, lambda f: F.struct(F.levenshtein(form_key(f), key).alias("d"), (-marks(f)).alias("a"), f.alias("form")))
    return F.array_min(ranked)["form"]
