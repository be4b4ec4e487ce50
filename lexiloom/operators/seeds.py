"""The best entries of each query by shared k-mers, as blocks of matrix products.

Joining postings makes a row of every k-mer that a query and an entry share, and words that
texts run together share hundreds with every other.  Here entries and queries meet block by
block instead: a block's k-mers are the columns of two small matrices, whose product holds
all scores, and only each query's best leave it.  All pairs are scored, none is left out by
an estimate.  K-mers of one alphabet are few (pairs of its consonants), so the columns are;
what one task holds is bounded by the block sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import Scratch

#: Entries and queries of a block, and queries whose scores are held at once.
ENTRIES, QUERIES, ROWS = 16_384, 512, 64

_OUT = pa.schema([("qid", pa.string()), ("id", pa.string()), ("score", pa.int64()), ("delta", pa.int32())])


def _matrix(kmers: pa.ListArray, columns: pa.Array) -> np.ndarray:
    """How often each row holds each column's k-mer."""
    sizes = pc.list_value_length(kmers).to_numpy(zero_copy_only=False)
    code = pc.fill_null(pc.index_in(kmers.flatten(), columns), -1).to_numpy(zero_copy_only=False)
    row, seen = np.repeat(np.arange(len(sizes)), sizes), code >= 0
    flat = np.bincount(row[seen] * len(columns) + code[seen], minlength=len(sizes) * len(columns))
    return flat.reshape(len(sizes), len(columns)).astype(np.float32)


def _top(key: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` highest keys of each row."""
    n = key.shape[1]
    if n <= most:
        return np.broadcast_to(np.arange(n), key.shape)
    return np.argpartition(key, n - most, axis=1)[:, n - most :]


def _block(most: int, near: int, each: int):
    """One block: each query's ``most`` best entries, and its ``each`` best of every length off by 0..``near``."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        q, e = t.filter(pc.is_valid(t["qid"])), t.filter(pc.is_valid(t["id"]))
        if not q.num_rows or not e.num_rows:
            return _OUT.empty_table()
        q, e = q.sort_by("n"), e.sort_by("id")  # of equal scores, the first id has the highest key
        qk, ek = q["kmers"].combine_chunks(), e["kmers"].combine_chunks()
        columns = pc.unique(qk.flatten())
        wanted, index = _matrix(qk, columns), _matrix(ek, columns).T
        q_len, e_len, n = q["n"].to_numpy(), e["n"].to_numpy(), e.num_rows
        late, found = np.arange(n - 1, -1, -1, dtype=np.float64), [[], [], []]
        for at in range(0, q.num_rows, ROWS):
            score = (wanted[at : at + ROWS] @ index).astype(np.float64)
            key, lens = score * n + late, q_len[at : at + ROWS]
            top = _top(key, most)
            pairs = [(np.repeat(np.arange(len(lens)), top.shape[1]) * n + top.ravel())]
            for length in np.unique(lens) if each else []:
                rows = np.flatnonzero(lens == length)
                for delta in range(near + 1):
                    cols = np.flatnonzero(np.abs(e_len - length) == delta)
                    top = cols[_top(key[np.ix_(rows, cols)], each)]
                    pairs.append(np.repeat(rows, top.shape[1]) * n + top.ravel())
            i, j = np.divmod(np.unique(np.concatenate(pairs)), n)
            hit = score[i, j] > 0
            i, j = i[hit], j[hit]
            for part, x in zip(found, (i + at, j, score[i, j]), strict=True):
                part.append(x)
        i, j, s = map(np.concatenate, found)
        delta = np.abs(e_len[j] - q_len[i])
        return pa.table([q["qid"].take(i), e["id"].take(j), s.astype(np.int64), delta.astype(np.int32)], schema=_OUT)

    return run


def best_seeds(queries: DataFrame, entries: DataFrame, most: int, near: int = 0, each: int = 0) -> DataFrame:
    """(qid, id, score, delta, pos): for (qid, kmers, n) and (id, kmers, n), the ``most`` best by score, ties by id.

    A query's k-mers count as often as it has them, an entry's once: its array must be distinct.
    With ``each``, the ``each`` best beyond those of every length off by 0..``near`` follow in the same
    order; ``pos`` is the place among all entries up to ``most``, and keeps their order above it.
    """
    scratch = Scratch(queries.sparkSession, "best-seeds")
    some = F.size("kmers") > 0  # asked of what is written: a filter would be pushed below the aggregate that makes words distinct
    e, n_e = scratch.write_counted(entries.select("id", "kmers", "n"), "entries", some)
    q, n_q = scratch.write_counted(queries.select("qid", "kmers", "n"), "queries", some)
    e, q = e.where(some), q.where(some)
    blocks = lambda n, size: max(1, -(-n // size))
    be, bq = blocks(n_e, ENTRIES), blocks(n_q, QUERIES)
    own, every = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("string")
    left = q.select(every(be).alias("_e"), own("qid", bq).alias("_q"), "qid", none.alias("id"), "kmers", "n")
    right = e.select(own("id", be).alias("_e"), every(bq).alias("_q"), none.alias("qid"), "id", "kmers", "n")
    # beyond the best, up to ``most`` of a length may stand among the best themselves
    run = _block(most, near, most + each if each else 0)
    got = left.unionByName(right).groupBy("_e", "_q").applyInArrow(run, "qid string, id string, score bigint, delta int")
    return got.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
