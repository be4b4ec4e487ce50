"""Duplicates hidden by formatting differences, collapsed and counted (p3).

Each record's canonical key (letters with their marks and digits, caseless) is hashed.
Every partition builds two Bloom filters over its hashes, one of hashes seen, one of
hashes seen again; per filter segment the partitions' parts are merged, where what two
partitions both have seen becomes *seen again*.  Only records whose hash may have been
seen again are shuffled, by their full key, for exact grouping; all others are singletons.

These filters take ``BITS_PER_RECORD`` bits a record, but lie in segments on the executors.
What every task gets is the filter of hashes seen again alone, folded to the size that
the bits set in it ask for: it grows with the repeats, not with the records, and never
beyond ``MAX_SENT_BITS``.  If repeats are more than that can hold apart, more singletons
are shuffled with them; no record is lost and no pass repeated.

Keys are grouped by their SHA-256 digest, so what is shuffled and sent is small however
long the texts are.  Groups above a bounded threshold are joined map-side, so no hot group
is one task's.

Defined results: null differs from every text; in one key field, texts that hold no
letter or digit agree with each other; exact repeats count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.unicode import letters_digits_key
from lexiloom.session import Scratch

BITS_PER_RECORD = 16
MIN_FILTER_BITS = 1 << 18
#: Bits of the folded filter that is sent to every task, at most, and per bit set in it, at least, up to that.
MAX_SENT_BITS, ROOM = 1 << 30, 4
#: Segments, the units in which filters are merged, have at least so many bits; there are at most so many of them.
LEAST_SEGMENT_BITS, MAX_SEGMENTS = 1 << 18, 1 << 14
#: A record's bits lie in one block.
BLOCK_BITS = 512
PROBES = 4
#: At most this many groups count as hot and are joined by broadcast.
MAX_HOT = 1_000
MIN_HOT_ROWS = 10_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def filter_bits(records: int) -> int:
    return power_of_two(max(MIN_FILTER_BITS, records * BITS_PER_RECORD))


def segment_bits(bits: int) -> int:
    return max(LEAST_SEGMENT_BITS, bits // MAX_SEGMENTS)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` bit positions of each hash, one row per hash.

    Those of a filter of half the bits are the same modulo its size, so filters can be folded.
    """
    h = hashes.view(np.uint64)
    # the mixed hash picks the block, nine bits each of the low half the bits within
    start = (((h * _MIX) >> np.uint64(16)) & np.uint64(bits // BLOCK_BITS - 1)) * np.uint64(BLOCK_BITS)
    within = [(h >> np.uint64(9 * j)) & np.uint64(BLOCK_BITS - 1) for j in range(PROBES)]
    return np.stack([start + w for w in within], axis=1)


def _pack(pos: np.ndarray) -> bytes:
    """Sorted positions within a segment as compressed gaps."""
    import zstandard

    return zstandard.compress(np.diff(pos, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.uint32), dtype=np.int64)


def partition_filters(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """Per partition and segment the bits of hashes seen and of hashes seen again."""
    wide = segment_bits(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) for b in batches if b.num_rows]
        if not got:
            return
        unique, n = np.unique(np.concatenate(got), return_counts=True)
        del got
        parts = []
        for h in (unique, unique[n > 1]):
            p = np.unique(positions(h, bits).ravel()).astype(np.int64)
            cut = np.searchsorted(p, np.arange(0, bits + 1, wide))
            parts.append((p, cut))
        out: dict[str, list] = {"segment": [], "once": [], "again": []}
        for s in range(bits // wide):
            once, again = (p[cut[s] : cut[s + 1]] - s * wide for p, cut in parts)
            if len(once):
                out["segment"].append(s)
                out["once"].append(_pack(once))
                out["again"].append(_pack(again) if len(again) else None)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]))

    return hashes.select(column).mapInArrow(build, "segment int, once binary, again binary")


def _segment_row(segment: int, bits: np.ndarray) -> pa.Table:
    pos = np.flatnonzero(bits)
    keep = [(segment, len(pos), _pack(pos))] if len(pos) else []
    return pa.table({"segment": pa.array([k for k, _, _ in keep], pa.int32()), "n": pa.array([n for _, n, _ in keep], pa.int64()), "again": pa.array([v for _, _, v in keep], pa.binary())})


def merged_again(parts: DataFrame, bits: int) -> DataFrame:
    """(segment, n, again): the merged filter of hashes seen again, as compressed positions and their number."""
    wide = segment_bits(bits)

    def merge(t: pa.Table) -> pa.Table:
        once, again = np.zeros(wide, bool), np.zeros(wide, bool)
        for row in zip(t.column("once"), t.column("again"), strict=True):
            new = _unpack(row[0].as_py())
            again[new[once[new]]] = True
            once[new] = True
            if row[1].is_valid:
                again[_unpack(row[1].as_py())] = True
        return _segment_row(t.column("segment")[0].as_py(), again)

    return parts.groupBy("segment").applyInArrow(merge, "segment int, n bigint, again binary")


def folded(merged: DataFrame, wide: int, sent_bits: int) -> DataFrame:
    """The merged filter's segments laid over each other until ``sent_bits`` are left."""

    def fold(t: pa.Table) -> pa.Table:
        again = np.zeros(wide, bool)
        for row in t.column("again"):
            again[_unpack(row.as_py())] = True
        return _segment_row(t.column("to")[0].as_py(), again)

    return merged.withColumn("to", F.expr(f"segment % {sent_bits // wide}")).groupBy("to").applyInArrow(fold, "segment int, n bigint, again binary")


def possible_repeats(keyed: DataFrame, column: str, records: int, scratch: Scratch) -> DataFrame:
    """``keyed`` with ``_maybe``: false only if no other record has the same hash."""
    bits = filter_bits(records)
    wide = segment_bits(bits)
    merged = scratch.write(merged_again(partition_filters(keyed, column, bits), bits), "again")
    full = merged.agg(F.sum("n")).first()[0] or 0
    sent_bits = max(wide, min(bits, MAX_SENT_BITS, power_of_two(full * ROOM)))
    rows = (merged if sent_bits == bits else folded(merged, wide, sent_bits)).collect()  # at most MAX_SENT_BITS / 8 bytes
    sent = keyed.sparkSession.sparkContext.broadcast([(r["segment"], bytes(r["again"])) for r in rows])
    scratch.drop("again")
    state: dict = {}

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        if "map" not in state:
            packed = np.zeros(sent_bits // 8, np.uint8)
            for s, data in sent.value:
                bit = np.zeros(wide, bool)
                bit[_unpack(data)] = True
                packed[s * wide // 8 : (s + 1) * wide // 8] = np.packbits(bit, bitorder="little")
            state["map"] = packed
        p = positions(h.to_numpy(np.int64), sent_bits)
        seen = (state["map"][p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return pd.Series(seen.all(axis=1))

    return keyed.withColumn("_maybe", maybe(F.col(column)))


def canonical_key(texts: list[str], exact: list[str]):
    """The key two records must share: caseless letters and digits of ``texts``, ``exact`` as they are."""
    parts = [F.coalesce(letters_digits_key(c), F.lit("\x00")) for c in texts]
    parts += [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in exact]
    return F.concat_ws("\x1f", *parts)


class Repeats:
    """Records keyed once and split into possible repeats and proven singletons."""

    def __init__(self, records: DataFrame, id_col: str, texts: list[str], exact: list[str], carry: list[str] | None = None):
        self.scratch = Scratch(records.sparkSession, "repeats")
        self.carry = carry or []
        digest = F.unhex(F.sha2(canonical_key(texts, exact), 256))
        rows = records.select(F.col(id_col).alias("_id"), digest.alias("_key"), *self.carry).withColumn("_hash", F.xxhash64("_key"))
        keyed, self.count = self.scratch.write_counted(rows, "keyed", "true")
        self.split = possible_repeats(keyed, "_hash", self.count, self.scratch)

    def groups(self) -> DataFrame:
        """(_key, first_id, n) of every key with more than one record."""
        possible = self.split.where("_maybe")
        return possible.groupBy("_key").agg(F.min("_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")

    def pairs(self) -> DataFrame:
        """(first_id, copy_id): one row for each record that repeats an earlier one."""
        groups = self.scratch.write(self.groups(), "groups")
        hot_rows = max(MIN_HOT_ROWS, -(-self.count // MAX_HOT))  # so at most MAX_HOT groups are hot
        hot = groups.where(F.col("n") >= hot_rows).select("_key", F.col("first_id").alias("hot_first"))
        members = self.split.where("_maybe").select("_key", "_id").join(F.broadcast(hot), "_key", "left")
        # materialised once: both branches below read it
        members = self.scratch.write(members.select(F.when(F.col("hot_first").isNull(), F.col("_key")).alias("_key"), "_id", "hot_first"), "members")
        warm = members.where("hot_first is not null").select(F.col("hot_first").alias("first_id"), F.col("_id").alias("copy_id"))
        cold = members.where("hot_first is null").select("_key", "_id").join(groups.where(F.col("n") < hot_rows), "_key")
        cold = cold.select("first_id", F.col("_id").alias("copy_id"))
        return warm.unionByName(cold).where("copy_id > first_id")

    def collapsed(self) -> DataFrame:
        """One record per set with ``n_copies``: the one with the smallest id."""
        best = F.min(F.struct("_id", *self.carry)).alias("_best")
        many = self.split.where("_maybe").groupBy("_key").agg(best, F.count("*").alias("n_copies"))
        many = many.select("_best.*", "n_copies")
        alone = self.split.where("not _maybe").select("_id", *self.carry, F.lit(1).cast("bigint").alias("n_copies"))
        return many.unionByName(alone)
