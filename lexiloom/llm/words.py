"""Words of texts as numbers, with their places, computed for many texts at once.

Words are runs of letters and digits of the folded text: composed, in lower case, final
sigma as sigma.  A word is known by a 64-bit number, a polynomial of its characters'
mixed codes; two of a billion different words share one with a chance of about 3 %, and
a phrase of words needs all of its numbers to agree.  Places are those of the text as it
is: where folding changes the number of characters, an offset map leads back to it, so
a word's range holds all characters that made it, marks included.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters taken through the arrays at once; a longer text is cut after a blank.
CHUNK = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_SEAM = re.compile(r"\s")


def fold(text: str) -> str:
    """Composed and in lower case, final sigma as sigma; may be longer or shorter than the text."""
    return unicodedata.normalize("NFC", text).lower().replace("ς", "σ")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(sys.maxunicode + 1)])


def _mixed(codes: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over character codes."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return _mixed(np.arange(sys.maxunicode + 1))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _clusters() -> re.Pattern:
    """What may fold to another number of characters: a character and what composes with it, or one that unfolds by itself."""
    joins = {d.split()[1] for d in map(unicodedata.decomposition, map(chr, range(sys.maxunicode + 1))) if d and d[0] != "<" and len(d.split()) == 2}
    after = {int(x, 16) for x in joins} | {i for i in range(sys.maxunicode + 1) if unicodedata.combining(chr(i))} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    after |= {i for i in range(sys.maxunicode + 1) if ord(unicodedata.normalize("NFD", chr(i))[0]) in after}
    alone = {i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and len(fold(chr(i))) != 1} - after
    cls = lambda s: "".join(f"\\U{i:08x}" for i in sorted(s))
    return re.compile(f"(?s:.)[{cls(after)}]+|[{cls(alone)}{cls(after)}]")


def offset_map(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the folded text, where what made it starts and ends in the text."""
    start, end, at = [], [], 0
    for m in _clusters().finditer(text):
        a, b = m.span()
        start.append(np.arange(at, a))
        end.append(np.arange(at + 1, a + 1))
        n = len(fold(m.group()))
        start.append(np.full(n, a))
        end.append(np.full(n, b))
        at = b
    start.append(np.arange(at, len(text)))
    end.append(np.arange(at + 1, len(text) + 1))
    return np.concatenate(start), np.concatenate(end)


def _scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end, index of the text) of all words of texts that fit into the arrays together."""
    folded = [fold(t) for t in texts]
    bounds = np.cumsum([0] + [len(f) + 1 for f in folded])
    codes = np.frombuffer(" ".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[False], _letters()[codes], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = max(CHUNK * 2, 1 << int(len(codes)).bit_length())
    power, inverse = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_codes()[codes] * power[: len(codes)], dtype=np.uint64)])
    number = _mixed((total[end] - total[start]) * inverse[start])
    owner = np.searchsorted(bounds, start, side="right") - 1
    start, end = start - bounds[owner], end - bounds[owner]
    for k, (t, f) in enumerate(zip(texts, folded, strict=True)):
        if len(t) != len(f) or not unicodedata.is_normalized("NFC", t):
            a, b = np.searchsorted(owner, [k, k + 1])
            if a < b:
                starts, ends = offset_map(t)
                start[a:b], end[a:b] = starts[start[a:b]], ends[end[a:b] - 1]
    return number, start, end, owner


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """A text in parts of about ``CHUNK`` characters, cut after blanks, with the place of each."""
    at = 0
    while at < len(text):
        seam = _SEAM.search(text, at + CHUNK)
        end = seam.end() if seam else len(text)
        yield at, text[at:end]
        at = end


def words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, start, end, index of the text) of the words of all texts, in order, some texts at a time."""
    block: list[tuple[int, int, str]] = []
    size = 0

    def flush():
        number, start, end, owner = _scan([t for _, _, t in block])
        which, base = np.array([k for k, _, _ in block]), np.array([b for _, b, _ in block])
        return number, start + base[owner], end + base[owner], which[owner]

    for k, text in enumerate(texts):
        for at, part in _pieces(text or ""):
            block.append((k, at, part))
            size += len(part)
            if size >= CHUNK:
                yield flush()
                block, size = [], 0
    if block:
        yield flush()
