"""An FM-index over words: wavelet-tree ranks, backward search of many phrases at once, sampled suffixes.

The text of a shard is one sequence of word numbers.  Number 0 separates documents; no
phrase holds it.  All steps are vectorised over the phrases with numpy.  An index can be
taken apart into plain bytes and put together again, so it may be stored and reused.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions a suffix position is kept for locating.
SAMPLE = 16
#: Bits counted per rank block.
BLOCK = 64


def pack_bits(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits) // BLOCK + 1) * BLOCK, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


class BitRank:
    """Counts of ones in prefixes of a packed bit array."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


def wavelet_levels(seq: np.ndarray, sigma: int) -> np.ndarray:
    """The packed bits of each level, highest bit first; symbols are parted stably from level to level."""
    out = []
    for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
        one = (seq >> level & 1).astype(bool)
        out.append(pack_bits(one))
        seq = np.concatenate([seq[~one], seq[one]])
    return np.stack(out)


class WaveletTree:
    """Levelwise wavelet structure over ``n`` symbols."""

    def __init__(self, levels: np.ndarray, n: int):
        self.bits = [BitRank(x) for x in levels]
        self.zeros = [n - int(b.before[-1]) for b in self.bits]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = ((symbol >> (len(self.bits) - 1 - k)) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its occurrences before it."""
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.get(i).astype(bool)
            a, b = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
            symbol = (symbol << 1) | one
        return symbol, i - start


def _groups(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys in ``slots``: the first slot of each key's run, and whether the run has more than one."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
    alone = new & np.concatenate([new[1:], [True]])
    return first, ~alone


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order; a suffix that ends sorts before its extensions.

    The first symbols are sorted as one packed key; then known ranks are doubled, and only
    suffixes that still tie with another are sorted again.
    """
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(seq.max() + 1).bit_length()
    step = max(1, 63 // bits)
    padded = np.concatenate([np.asarray(seq, np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[order], tied = _groups(key[order], np.arange(n))
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        follow = at + step
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        rank[at], tied = _groups(key, slots)
        slots = slots[tied]
        step *= 2
    return order


class FMIndex:
    """Searches and locates; ``build`` makes one, ``parts`` and ``load`` store it."""

    def __init__(self, n: int, levels: np.ndarray, counts: np.ndarray, marks: np.ndarray, samples: np.ndarray):
        self.n, self.counts, self.samples = n, counts, samples
        self.tree = WaveletTree(levels, n)
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.marks = BitRank(marks)

    @classmethod
    def build(cls, seq: np.ndarray, sigma: int) -> FMIndex:
        """``seq``: word numbers in [0, sigma); the index adds its own end mark."""
        text = np.concatenate([np.asarray(seq, np.int64) + 1, [0]])  # 0 is the end mark
        order = suffix_array(text)
        sampled = order % SAMPLE == 0
        return cls(
            len(text), wavelet_levels(text[order - 1].astype(np.int32), sigma + 1), np.bincount(text, minlength=sigma + 1).astype(np.uint32),
            pack_bits(sampled), order[sampled].astype(np.uint32),
        )

    def parts(self) -> dict[str, bytes]:
        levels = b"".join(b.words.tobytes() for b in self.tree.bits)
        return {"levels": levels, "counts": self.counts.tobytes(), "marks": self.marks.words.tobytes(), "samples": self.samples.tobytes()}

    @classmethod
    def load(cls, n: int, levels: bytes, counts: bytes, marks: bytes, samples: bytes) -> FMIndex:
        bits = np.frombuffer(levels, np.uint64).reshape(-1, n // BLOCK + 1)
        return cls(n, bits, np.frombuffer(counts, np.uint32), np.frombuffer(marks, np.uint64), np.frombuffer(samples, np.uint32))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the phrases, one per row, all of one length."""
        m = len(phrases)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        alive = np.arange(m)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, j] + 1
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low[alive], high[alive]]))
            low[alive] = self.first[c] + both[: len(c)]
            high[alive] = self.first[c] + both[len(c) :]
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        dead = np.ones(m, bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by walking back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marks.get(at[todo]).astype(bool)
            done = todo[hit]
            out[done] = self.samples[self.marks.rank(at[done])] + steps[done]
            todo = todo[~hit]
            if len(todo):
                c, r = self.tree.access_rank(at[todo])
                at[todo] = self.first[c] + r
                steps[todo] += 1
        return out
