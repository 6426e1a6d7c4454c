"""Vectorised word and word-window hashing over UTF-8 bytes.

A word's hash is a polynomial over a byte table, evaluated for all words of a
buffer with one prefix sum; window hashes do the same over word hashes.  Both
cost a constant number of numpy passes, whatever the window's length.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20  # bytes hashed at once: bounds the temporary arrays, not the text


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """One hash function; ``seed`` picks it."""

    def __init__(self, seed: int = 1):
        s = np.uint64(seed * 1000003)
        base = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.table = mix64(base + s + np.uint64(1))
        self.p = int(mix64(np.array([seed * 7 + 3], np.uint64))[0]) | 5
        self.q = int(mix64(np.array([seed * 11 + 5], np.uint64))[0]) | 5
        self._pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._pow.get(base)
        if have is None or len(have[0]) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            inv = pow(base, -1, 1 << 64)
            out = []
            for b in (base, inv):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
            have = self._pow[base] = (out[0], out[1])
        return have[0][:n], have[1][:n]

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of raw[starts[i]:ends[i]]; words are in order and don't overlap."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
            hi = int(ends[j - 1])
            pw, inv = self.powers(self.p, hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.table[raw[lo:hi]] * pw[:-1], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            i = j
        return mix64(out)

    def windows(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of every run of ``n`` word hashes; empty if there are fewer."""
        if len(words) < n:
            return np.empty(0, np.uint64)
        pw, inv = self.powers(self.q, len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * pw[:-1], out=total[1:])
        return mix64((total[n:] - total[:-n]) * inv[: len(words) - n + 1] + np.uint64(n))


def word_spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``is_word`` (256 booleans) accepts."""
    starts, ends, carry = [], [], 0
    for lo in range(0, len(raw), SEGMENT):
        w = is_word[raw[lo : lo + SEGMENT]].view(np.int8)
        d = np.diff(w, prepend=np.int8(carry))
        starts.append(np.flatnonzero(d == 1) + lo)
        ends.append(np.flatnonzero(d == -1) + lo)
        carry = w[-1]
    if carry:
        ends.append(np.array([len(raw)]))
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
    return cat(starts), cat(ends)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


class Pack:
    """Several texts as one buffer, a line feed after each, so that no word spans two."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.starts, self.ends = word_spans(self.raw, is_word)
        #: word index where each text begins, and one past the last
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends, "left")])
        self.limit = np.repeat(self.first[1:], np.diff(self.first))

    def fitting(self, n: int) -> np.ndarray:
        """Word indices where a window of n words fits in its text."""
        return np.flatnonzero(np.arange(len(self.starts)) + n <= self.limit)


def packs(rows, size: int = 1 << 20):
    """Lists of (key, bytes) from an iterable of them, cut when their texts reach ``size`` bytes."""
    out, total = [], 0
    for key, text in rows:
        out.append((key, text))
        total += len(text)
        if total >= size:
            yield out
            out, total = [], 0
    if out:
        yield out
