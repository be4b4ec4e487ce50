"""Evaluation passages inside training text, found through an FM-index per shard (p6).

``build_index`` cuts each training partition into shards of bounded size, never a
document, and builds over each shard's words an FM-index, stored as one row of plain
bytes; nothing of it depends on the test items, so one index serves any item set.
``search`` takes every run of ``words`` consecutive words of the items as phrases,
searches all of them backward at once through the shard's wavelet-tree ranks, locates
the occurrences by sampled suffix positions, maps them to documents and merges
overlapping ones to removal spans.

Words and their places are defined in ``words``.  Defined results: null and empty texts
hold nothing; an item with fewer words than a phrase leaks nowhere; texts are processed
whole, whatever their length; rows that repeat an id are searched each.

The items go to every task in blocks of at most ``MAX_ITEM_BYTES`` of text (a single
item is not cut), one pass over the index each; the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import words as W
from lexiloom.llm.fmindex import FMIndex
from lexiloom.session import Scratch

WORDS = 12
#: Words of one shard's index from which it is closed; a document is never cut.
SHARD_WORDS = 1_000_000
#: Bytes of item texts that one pass takes along.
MAX_ITEM_BYTES = 4 << 20
#: Bytes of one row group of a stored index, so that no reader holds more at once.
ROW_GROUP = 16 << 20

_BYTES = ("numbers", "levels", "counts", "marks", "samples", "gaps", "sizes")


def _stored(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(values.astype(np.int32).tobytes(), 1)


def _restored(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.int32).astype(np.int64)


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ``docs`` (ids), ``ends`` (place of each one's separator), the index's bytes and the words' places.

    ``numbers`` are the sorted word numbers, ``gaps`` and ``sizes`` the characters between and in the words.
    """
    kind = documents.schema[doc_id].dataType
    schema = f"docs array<{kind.simpleString()}>, ends array<int>, n int, " + ", ".join(f"{c} binary" for c in _BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list[tuple] = []
        held, id_type = 0, pa.int64()

        def flush() -> pa.RecordBatch:
            number, start, end, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            known, place = np.unique(number, return_inverse=True)
            docs, per_doc = np.unique(owner, return_counts=True)
            ends = np.cumsum(per_doc + 1) - 1
            seq = np.zeros(len(number) + len(docs), np.int64)
            seq[np.arange(len(number)) + np.repeat(np.arange(len(docs)), per_doc)] = place + 1
            index = FMIndex.build(seq, len(known) + 1)
            before = np.concatenate([[0], end[:-1]])
            before[np.cumsum(per_doc) - per_doc] = 0
            row = {"numbers": known.tobytes(), **index.parts(), "gaps": _stored(start - before), "sizes": _stored(end - start)}
            cols = [pa.array([[ids[k] for k in docs.tolist()]], pa.list_(id_type)), pa.array([ends.tolist()], pa.list_(pa.int32())), pa.array([index.n], pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array([row[c]], pa.binary()) for c in _BYTES]], ["docs", "ends", "n", *_BYTES])

        for b in batches:
            id_type = b.schema.field(0).type
            base = len(ids)
            ids += b.column(0).to_pylist()
            for number, start, end, owner in W.words(b.column(1).to_pylist()):
                # a shard may end between two documents only
                if held >= SHARD_WORDS and len(owner) and owner[0] + base != parts[-1][3][-1]:
                    yield flush()
                    parts, held = [], 0
                if len(number):
                    parts.append((number, start, end, owner + base))
                    held += len(number)
            if not parts:
                ids = []
        if parts:
            yield flush()

    return documents.select(doc_id, text).mapInArrow(run, schema)


class Phrases:
    """The distinct runs of ``words`` words of some items as rows of word numbers, and which items hold each."""

    def __init__(self, items: list[tuple[int, str | None]], words: int):
        rows, owner = [np.zeros((0, words), np.uint64)], [np.zeros(0, np.int64)]
        for number, _, _, text in _by_text([t for _, t in items]):
            if len(number) >= words:
                rows.append(np.lib.stride_tricks.sliding_window_view(number, words))
                owner.append(np.full(len(number) - words + 1, text))
        grams, holder = np.concatenate(rows), np.concatenate(owner)
        self.rows, which = np.unique(grams, axis=0, return_inverse=True)
        # the phrases of each item
        pairs = np.unique(np.stack([holder, which.ravel()], axis=1), axis=0) if len(holder) else np.zeros((0, 2), np.int64)
        cut = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        self.items = [(items[int(k)][0], p) for k, p in zip(pairs[cut, 0], np.split(pairs[:, 1], cut[1:]), strict=True)] if len(pairs) else []


def _by_text(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Number, start and end of each text's words, text by text."""
    parts = list(W.words(texts))
    if not parts:
        return
    number, start, end, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(owner)], strict=True):
        yield number[a:b], start[a:b], end[a:b], int(owner[a])


def _hits(shard: dict, phrases: Phrases, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each item found in a shard: item, and document index, first and last word of the merged occurrences."""
    known = np.frombuffer(shard["numbers"], np.uint64)
    place = np.searchsorted(known, phrases.rows)
    there = (known[np.minimum(place, len(known) - 1)] == phrases.rows).all(axis=1)
    tried = np.flatnonzero(there)
    if not len(tried):
        return
    index = FMIndex.load(shard["n"], *[shard[c] for c in ("levels", "counts", "marks", "samples")])
    low, high = index.search(place[tried].astype(np.int64) + 1)
    n = high - low
    if not n.any():
        return
    # a place starts one phrase at most, so all occurrences fit beside the index
    first = np.zeros(len(phrases.rows) + 1, np.int64)
    first[tried + 1] = n
    first = np.cumsum(first)
    at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
    ends = np.asarray(shard["ends"], np.int64)
    for item, own in phrases.items:
        size = first[own + 1] - first[own]
        if not size.any():
            continue
        p = np.sort(at[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[own], size)])
        new = np.concatenate([[True], np.diff(p) > words])
        begin, last = p[new], p[np.concatenate([new[1:], [True]])] + words - 1
        doc = np.searchsorted(ends, begin, side="right")
        # separators are no words
        yield item, doc, begin - doc, last - doc


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", words: int = WORDS, spans: bool = True) -> DataFrame:
    """(doc_id, item_id, spans) of a stored index: what of each item each document holds.

    ``spans`` are the merged character ranges [start, end) of the text to remove; left out if not asked for.
    """
    scratch = Scratch(index.sparkSession, "leaks")
    blocks = _blocks(items, item_id, item_text)
    if len(blocks) == 1:
        return _search_block(index, blocks[0](), doc_id, words, spans)[0]
    names = []
    for block in blocks:
        found, sent = _search_block(index, block(), doc_id, words, spans)
        names.append(f"block{len(names)}")
        scratch.write(found, names[-1])
        sent.destroy()
    return scratch.read(names)


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list:
    """Functions that fetch the items block by block."""
    rows = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_t")).where(F.col(item_text).isNotNull())
    size = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = -(-2 * size // MAX_ITEM_BYTES) if size > MAX_ITEM_BYTES else 1

    def fetch(k: int):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("_i"), F.lit(n)) == k)
        return lambda: [(r[0], r[1]) for r in part.toLocalIterator()]

    return [fetch(k) for k in range(n)]


def _search_block(index: DataFrame, items: list, doc_id: str, words: int, spans: bool):
    sent = index.sparkSession.sparkContext.broadcast(Phrases(items, words))
    columns = ["docs", "ends", "n", *_BYTES[: None if spans else -2]]
    kind = index.schema["docs"].dataType.elementType.simpleString()
    schema = f"{doc_id} {kind}, item_id bigint" + (", spans array<struct<start:int,end:int>>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for b in batches:
            for k in range(b.num_rows):
                shard = {c: b.column(i)[k].as_py() for i, c in enumerate(columns) if c != "docs"}
                docs = b.column(0)[k].values
                places = None
                for item, doc, first, last in _hits(shard, phrases, words):
                    cut = np.flatnonzero(np.diff(doc, prepend=-1))
                    out = [docs.take(pa.array(doc[cut])), pa.array(np.full(len(cut), item), pa.int64())]
                    if spans:
                        places = places or _places(shard)
                        pair = pa.StructArray.from_arrays([pa.array(places[0][first], pa.int32()), pa.array(places[1][last], pa.int32())], ["start", "end"])
                        out.append(pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)), pa.int32()), pair))
                    yield pa.RecordBatch.from_arrays(out, [doc_id, "item_id", "spans"][: len(out)])

    return index.select(*columns).mapInArrow(run, schema), sent


def _places(shard: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a shard in its document's text."""
    gaps, sizes = _restored(shard["gaps"]), _restored(shard["sizes"])
    end = np.cumsum(gaps + sizes)
    per_doc = np.diff(np.asarray(shard["ends"], np.int64), prepend=-1) - 1
    first = np.cumsum(per_doc) - per_doc
    end = end - np.repeat(end[first] - gaps[first] - sizes[first], per_doc)
    return end - sizes, end


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, spans: bool = True) -> DataFrame:
    """``build_index``, written once, and ``search``."""
    index = Scratch(documents.sparkSession, "fmindex").write(build_index(documents, doc_id, text), "index", row_group=ROW_GROUP)
    return search(index, items, item_id, item_text, doc_id, words, spans)
