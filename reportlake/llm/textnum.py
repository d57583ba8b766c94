"""Whole-text word hashing on Arrow buffers.

A batch of texts is handled as one byte buffer: words, their 64-bit hashes and
hashes of word windows come from prefix sums, without a Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time.
PIECE = 1 << 20
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers, for :func:`spans`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal content wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


class Words:
    """Words of several texts: byte spans, hashes and the text each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data = ASCII_LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~SEPARATOR[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.hash = self._hashes()
        #: Word number at which each text starts; one more entry than texts.
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def _hashes(self) -> np.ndarray:
        """Hashes of the words; some bytes at a time, so that a long text needs no array of numbers as long as itself."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, side="right")))
            a = self.start[i]
            out[i:j] = spans(prefix(_BYTE[self.data[a : self.end[j - 1]]]), self.start[i:j] - a, self.end[i:j] - a)
            i = j
        return out

    def windows(self, k: int) -> np.ndarray:
        """Starts of the windows of k words that lie within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :])

    def word_bytes(self, i: int, j: int) -> bytes:
        """Words i to j-1 of one text joined by one space."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join([raw[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if have < width:
        n = len(x) - width + 1
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of at most ``limit`` bytes of text, or one row; nulls count as empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        at = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            j = min(j, len(texts))
            yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
