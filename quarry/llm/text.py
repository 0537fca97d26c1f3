"""Vectorised words and n-grams of a column of texts (numpy inside tasks).

A word is a maximal run of bytes outside the separator set; the default set is
``\\x20`` and ``\\x09-\\x0D``, and A-Z count as a-z. Words and n-grams are named
by 64-bit hashes of their bytes. Texts are taken whole; a batch is cut only
between texts, so memory is bounded by the chunk size or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
GRAM = U(0xD6E8FEB86659FD93)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Separators when punctuation does not belong to words.
PUNCTUATED = SPACES + bytes(c for c in range(33, 127) if not chr(c).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = np.full(n, base, U)
        if n:
            p[0] = U(1)
        return np.cumprod(p, dtype=U)


_STEP = 1 << 16


def _powers_at(at: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Powers of ``base`` with the exponents ``at`` (below ``n``), from two short tables."""
    with np.errstate(over="ignore"):
        near = _powers(_STEP, base)
        far = _powers(n // _STEP + 1, U(pow(int(base), _STEP, 1 << 64)))
        return far[at // _STEP] * near[at % _STEP]


def _weighted_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of ``codes[data] * _BASE ** place`` before each place, taken in short steps: only the sums span the data."""
    total = np.zeros(len(data) + 1, U)
    near, scale = _powers(min(_STEP, len(data)), _BASE), U(1)
    step = U(pow(int(_BASE), _STEP, 1 << 64))
    with np.errstate(over="ignore"):
        for s in range(0, len(data), _STEP):
            part = codes[data[s:s + _STEP]]
            part *= near[:len(part)]
            part *= scale
            part[0] += total[s]
            np.cumsum(part, dtype=U, out=total[s + 1:s + 1 + len(part)])
            scale = scale * step
    return total


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of marked bytes; runs end with their document."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets[1:], start, side="right")


class Words:
    """Words of a chunk: ``hash``, byte ``start``/``end`` and ``doc`` of each,
    and ``first`` with the index of each document's first word (n + 1 entries)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES):
        sep = np.zeros(256, bool)
        sep[list(separators)] = True
        lower = np.arange(256, dtype=np.int64)
        lower[65:91] += 32
        codes = mix((lower + 1).astype(U) * GRAM)
        n = len(data)
        self.start, self.end, self.doc = spans_of(~sep[data], offsets)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.offsets = offsets
        with np.errstate(over="ignore"):
            total = _weighted_sums(data, codes)
            h = (total[self.end] - total[self.start]) * _powers_at(self.start, n + 1, _BASE_INV)
            self.hash = mix(h + (self.end - self.start).astype(U) * GRAM)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and whether they lie in one document."""
        n = len(self.hash)
        if n < k:
            return np.zeros(n, U), np.zeros(n, bool)
        h = run_hash(self.hash, k)
        ok = np.zeros(n, bool)
        ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1:]
        return np.concatenate([h, np.zeros(k - 1, U)]), ok

    def runs(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each position of ``at`` (any length at the same cost)."""
        n = len(self.hash)
        with np.errstate(over="ignore"):
            if not hasattr(self, "_sums"):
                self._sums = np.zeros(n + 1, U)
                np.cumsum(self.hash * _powers(n, _BASE), dtype=U, out=self._sums[1:])
                self._back = _powers(n + 1, _BASE_INV)
            return mix((self._sums[at + length] - self._sums[at]) * self._back[at] + U(length))


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring word hashes (len - k + 1 values)."""
    with np.errstate(over="ignore"):
        m = len(words) - k + 1
        h, p = words[:m].copy(), GRAM
        for j in range(1, k):
            h += words[j:m + j] * p
            p = p * GRAM
        return mix(h + U(k))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20):
    """Slices of a batch with at most ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, used = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and used + s > limit:
            yield batch.slice(lo, i - lo)
            lo, used = i, 0
        used += int(s)
    yield batch.slice(lo)
