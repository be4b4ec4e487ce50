"""Oversized texts cut into pieces under a token limit at natural boundaries (p8).

A text over the limit is split by sections; what is still too long by paragraphs, then
sentences, words and characters.  The units so found are packed greedily, and each
piece starts with the last ``overlap`` tokens of the one before (up to three more where
a token ends within a character).  Cuts fall on token bounds, and every piece is encoded
again to make sure that it is within the limit.

Defined results: null and empty texts give no piece; a text within the limit is one
piece; joining the pieces without their overlaps gives the text back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.tokens import VOCABULARY, arrived, encode, encoding, ship

LIMIT, OVERLAP = 2048, 128

#: Where a unit may end, the strongest separators first; characters come last by themselves.
LEVELS = (
    re.compile(r"\f|\n{3,}|\n(?=#{1,6} )|\n[ \t]*[-=*_]{3,}[ \t]*\n"),
    re.compile(r"\n[ \t]*\n"),
    re.compile(r"[.!?;·…][\"'»”’)\]]*(?=\s)|\n"),
    re.compile(r"(?<=\S)(?=\s)"),
)


def cut(text: str, enc, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, new, end, tokens) of each piece in characters; ``new`` is where the overlap ends."""
    tokens = encode(enc, text)
    n = len(tokens)
    if n <= limit:
        return [(0, 0, len(text), n)] if text else []
    raw = np.frombuffer(text.encode(), np.uint8)
    chars = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])  # first byte of each character
    ends = np.concatenate([[0], np.cumsum([len(b) for b in enc.decode_tokens_bytes(tokens)])])
    at = np.searchsorted(chars, ends)
    whole = chars[at] == ends  # token bounds that are character bounds
    bounds = np.flatnonzero(whole)
    place = {int(e): i for i, e in zip(bounds, ends[bounds], strict=True)}
    levels: dict[int, np.ndarray] = {}

    def level_bounds(k: int) -> np.ndarray:
        if k not in levels:
            found = (place.get(int(chars[m.end()])) for m in LEVELS[k].finditer(text))
            levels[k] = np.array(sorted({x for x in found if x is not None}), np.int64)
        return levels[k]

    room = limit - overlap - 3  # a unit must fit beside the overlap

    def units(a: int, b: int, k: int) -> Iterator[int]:
        if b - a <= room or k == len(LEVELS):
            yield b
            return
        inner = level_bounds(k)
        inner = inner[np.searchsorted(inner, a, side="right") : np.searchsorted(inner, b)]
        for x, y in zip([a, *inner.tolist()], [*inner.tolist(), b], strict=True):
            yield from units(x, y, k + 1)

    stops = np.array(list(units(0, n, 0)), np.int64)
    pieces, done = [], 0
    while done < n:
        start = int(bounds[np.searchsorted(bounds, done - overlap, side="right") - 1]) if done else 0
        most = start + limit
        while True:
            i = np.searchsorted(stops, most, side="right") - 1
            end = int(stops[i]) if i >= 0 and stops[i] > done else 0
            if not end:  # no natural end fits
                end = int(bounds[np.searchsorted(bounds, most, side="right") - 1])
            if end <= done:  # not even one character fits beside the overlap
                end = int(bounds[np.searchsorted(bounds, done, side="right")])
                start = done
            a, b = int(at[start]), int(at[end])
            size = len(encode(enc, text[a:b]))
            if size <= limit or end <= done + 1:
                break
            most = end - 1
        pieces.append((a, int(at[done]), b, size))
        done = end
    return pieces


def pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, path: str = VOCABULARY) -> DataFrame:
    """(id, piece, char_start, new_start, char_end, n_tokens, piece_text) of every text that may be oversized.

    A text of at most ``limit`` bytes has no more tokens and never reaches Python.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, char_start int, new_start int, char_end int, n_tokens int, piece_text string"

    ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(arrived(path))
        for b in batches:
            rows: list[tuple] = []
            for k, (i, t) in enumerate(zip(b.column(0), b.column(1).to_pylist(), strict=True)):
                for j, (a, new, e, size) in enumerate(cut(t, enc, limit, overlap)):
                    rows.append((i.as_py(), j, a, new, e, size, t[a:e]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [b.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [id_col, "piece", "char_start", "new_start", "char_end", "n_tokens", "piece_text"])

    return df.where(F.octet_length(text) > limit).select(id_col, text).mapInArrow(run, schema)
