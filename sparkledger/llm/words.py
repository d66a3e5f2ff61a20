"""Vectorised word and window hashing over Arrow string batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8
text, which is the code point class ``[^\\x20\\x09-\\x0D]+``.  Null text counts
as empty text.  Hashes are 64-bit polynomial hashes with a final mix; every
operator that must be exact confirms hash hits on words or on digests of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text bytes hashed in one go; a longer document is still taken whole.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; low and high bits of the result are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Of _BASE from the start: a word's hash must not depend on how long the words before it were.
_POWERS = powers(_BASE, 64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = powers(_BASE, max(n, 2 * len(_POWERS)))
    return _POWERS


class Words:
    """Words of some documents: byte spans, 64-bit hashes, and the words' index range per document."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc_words: np.ndarray):
        self.data, self.starts, self.ends, self.hashes, self.doc_words = data, starts, ends, hashes, doc_words

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``size`` words, by first word; and whether it stays in one document."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        acc = np.zeros(n, dtype=np.uint64)
        for j, p in enumerate(powers(_STEP, size)):
            acc += self.hashes[j : j + n] * p
        counts = np.diff(self.doc_words)
        doc = np.repeat(np.arange(len(counts)), counts)
        return mix(acc + np.uint64(size)), doc[:n] == doc[size - 1 : size - 1 + n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array, null as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def split_words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents raw[off[i]:off[i + 1]]."""
    lo, hi = int(off[0]), int(off[-1])
    data = raw[lo:hi]
    off = off - lo
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    doc_words = np.searchsorted(starts, off)
    if not len(starts):
        return Words(data, starts, ends, np.zeros(0, np.uint64), doc_words)
    lens = ends - starts
    chars = data[inside]
    if lower:
        chars = _LOWER[chars]
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, lens)
    pw = _powers(int(lens.max()))
    hashes = mix(np.add.reduceat(_BYTE[chars] * pw[place], first) + lens.astype(np.uint64))
    return Words(data, starts, ends, hashes, doc_words)


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of documents with at most so many bytes, or one document."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
