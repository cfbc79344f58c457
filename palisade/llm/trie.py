"""An Elias-Fano n-gram trie of one shard: compact levels, read from memory-mapped files."""

from __future__ import annotations

from pathlib import Path

import numpy as np

#: Bits of the unary string that one count in memory stands for, and queries that are answered at a time.
BLOCK, PART = 128, 1 << 15
#: Where the k-th one of a byte is, from its top bit.
_PLACE = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    for _k, _at in enumerate(i for i in range(8) if _byte >> (7 - i) & 1):
        _PLACE[_byte, _k] = _at


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value.

    The low bits are packed side by side; the high bits are a unary bit string
    (a one per value, a zero per step). Both are read where they are mapped;
    only a count of ones per BLOCK bits is held in memory.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, bits: int):
        self.n, self.bits = n, bits
        self.words = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
        self.rows = high.reshape(-1, BLOCK // 8)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64))])
        self.zeros = np.arange(len(self.ones)) * BLOCK - self.ones
        self.steps = int(self.zeros[-1])

    @classmethod
    def write(cls, values: np.ndarray, path: Path) -> "EliasFano":
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, min(56, (max(top, 1) // max(n, 1)).bit_length() - 1))
        low = np.zeros((n, bits), dtype=np.uint8)
        for b in range(bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        np.append(np.packbits(low, bitorder="little"), np.zeros(8, dtype=np.uint8)).tofile(path.with_suffix(".low"))
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(-(-(n + (top >> bits) + 2) // BLOCK) * BLOCK, dtype=np.uint8)
        unary[high + np.arange(n)] = 1
        np.packbits(unary).tofile(path.with_suffix(".high"))
        return cls.open(path, n, bits)

    @classmethod
    def open(cls, path: Path, n: int, bits: int) -> "EliasFano":
        return cls(*(np.memmap(path.with_suffix(s), dtype=np.uint8, mode="r") for s in (".low", ".high")), n, bits)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the k-th one (or zero) of the unary string is."""
        out, before = np.empty(len(k), dtype=np.int64), self.ones if one else self.zeros
        for a in range(0, len(k), PART):
            want = k[a : a + PART]
            row = np.searchsorted(before, want, side="right") - 1
            raw = np.asarray(self.rows[row])
            raw = raw if one else ~raw
            upto = np.cumsum(np.bitwise_count(raw), axis=1, dtype=np.int64)
            rest = want - before[row]
            byte = (upto <= rest[:, None]).sum(axis=1)
            each = np.arange(len(want))
            rest -= np.where(byte > 0, upto[each, byte - 1], 0)
            out[a : a + PART] = row * BLOCK + byte * 8 + _PLACE[raw[each, byte], rest]
        return out

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=np.uint64)
        off = at * self.bits
        return (self.words[off >> 3] >> (off & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        return ((self._select(at, True) - at).astype(np.uint64) << np.uint64(self.bits)) | self._low(at)

    def find(self, targets: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Where each target is in its range of places, -1 if it is not: a search among the values of its high part there."""
        if not self.n or not len(targets):
            return np.full(len(targets), -1)
        high = (targets >> np.uint64(self.bits)).astype(np.int64)
        inside = high < self.steps
        high = np.where(inside, high, 0)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        lo, stop = np.maximum(first, begin), np.minimum(self._select(high, False) - high, self.n if end is None else end)
        want, hi = targets & np.uint64((1 << self.bits) - 1), stop.copy()
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) >> 1, 0)
            less = self._low(mid) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        met = inside & (lo < stop)
        return np.where(met & (self._low(np.where(met, lo, 0)) == want), lo, -1)


class Trie:
    """Contexts, pointers to their successors, the successors, and quantised probabilities.

    Successors are numbered within the shard's own vocabulary. A context's
    range begins where its pointer says; its numbers are stored on top of the
    last value of the range before, which makes the level one monotone
    sequence, and are searched relative to it within the range.
    """

    CODES = 255

    def __init__(self, folder: Path, contexts: np.ndarray, runs: np.ndarray, words: np.ndarray, logs: np.ndarray):
        """contexts: sorted. runs: successors of each. words: successors, sorted within a context. logs: log10 probabilities."""
        vocab = np.unique(words)
        self.contexts = EliasFano.write(contexts, folder / "contexts")
        self.vocab = EliasFano.write(vocab, folder / "vocab")
        ends = np.cumsum(runs)
        self.pointers = EliasFano.write(np.concatenate([[0], ends]).astype(np.uint64), folder / "pointers")
        rank = np.searchsorted(vocab, words).astype(np.uint64)
        last = rank[ends - 1] if len(ends) else rank
        base = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(last, dtype=np.uint64)[:-1]]) if len(ends) else last
        self.level = EliasFano.write(np.repeat(base, runs) + rank, folder / "successors")
        # Even steps bound the error of each probability.
        self.low, self.high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        step = (self.high - self.low) / (self.CODES - 1)
        codes = np.round((logs - self.low) / step) if step else np.zeros(len(logs))
        np.append(codes + 1, 0).astype(np.uint8).tofile(folder / "codes")
        self.codes = np.memmap(folder / "codes", dtype=np.uint8, mode="r")

    @classmethod
    def probabilities(cls, codes: np.ndarray, low: float, high: float) -> np.ndarray:
        """Probabilities of codes: 0 for code 0."""
        return np.where(codes > 0, 10.0 ** (low + (codes - 1.0) * ((high - low) / (cls.CODES - 1))), 0.0)

    def lookup(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Code of each (context, word): 0 if unseen."""
        out = np.zeros(len(contexts), dtype=np.uint8)
        each, of = np.unique(contexts, return_inverse=True)
        parent = self.contexts.find(each)
        there = np.maximum(parent, 0)
        if not self.contexts.n or not len(each):
            return out
        begin, end = (self.pointers.access(there + k).astype(np.int64) for k in (0, 1))
        base = np.where(begin > 0, self.level.access(np.maximum(begin - 1, 0)), np.uint64(0))
        rank = self.vocab.find(words)
        asked = np.flatnonzero((parent[of] >= 0) & (rank >= 0))
        ctx = of[asked]
        at = self.level.find(base[ctx] + rank[asked].astype(np.uint64), begin[ctx], end[ctx])
        out[asked[at >= 0]] = self.codes[at[at >= 0]]
        return out
