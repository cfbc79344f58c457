"""Word hashes of a batch of texts, in numpy: small helpers for work inside tasks."""

from __future__ import annotations

import numpy as np

#: Letters of the contract: A-Z become a-z; 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F separate.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: White space alone separates: 0x09-0x0D and 0x20.
SPACED = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _MUL, dtype=np.uint64))
_FURTHER = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 12) - 1, _POWERS[-1], dtype=np.uint64)]), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of several texts: one 64-bit hash per word, and where each text's words begin and end."""

    def __init__(self, texts: list, table: bytes = ALNUM):
        parts = [(t or "").encode("utf-8", "surrogatepass").translate(table) for t in texts]
        self.data = b" ".join(parts) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        inside = np.empty(len(raw) + 1, dtype=np.int8)
        inside[0] = 0
        np.not_equal(raw, 32, out=inside[1:], casting="unsafe")
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = self._hashes(raw)
        ends = np.cumsum([len(p) + 1 for p in parts])
        last = np.searchsorted(self.start, ends)
        self.last = last
        self.first = np.concatenate([[0], last[:-1]]) if len(last) else last

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        size = self.end - self.start
        at = np.arange(len(raw), dtype=np.int64)
        begin = np.repeat(self.start, np.diff(np.append(self.start, len(raw))))
        at[self.start[0] :] -= begin
        at[: self.start[0]] = 0
        value = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[at & (len(_POWERS) - 1)]
        if size.max() > len(_POWERS):
            value *= _FURTHER[(at >> 12) & (len(_FURTHER) - 1)]
        value[raw == 32] = 0
        return mix64(np.add.reduceat(value, self.start) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they lie in one text)."""
        total = len(self.hash)
        if total < n:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool)
        out = self.hash[: total - n + 1].copy()
        for j in range(1, n):
            out *= np.uint64(0x5851F42D4C957F2D)
            out += self.hash[j : total - n + 1 + j]
        whole = np.zeros(total + 1, dtype=bool)
        for a, b in zip(self.first, self.last, strict=True):
            if b - a >= n:
                whole[a : b - n + 1] = True
        return mix64(out), whole[: total - n + 1]

    def text(self, word: int, n: int) -> bytes:
        """n words from a word on, as normalised bytes with single spaces."""
        return b" ".join(self.data[self.start[word] : self.end[word + n - 1]].split())
