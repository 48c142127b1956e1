"""Texts of Arrow batches as byte arrays, and word hashes found on those bytes with numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes scanned at once; bounds the memory of the arrays made on the way.
PIECE = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts and ends (a null is empty)."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = bounds[:-1].copy(), bounds[1:].copy()
    if column.null_count:
        ends = np.where(column.is_valid().to_numpy(zero_copy_only=False), ends, starts)
    return raw, starts, ends


def pieces(starts: np.ndarray, ends: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` bytes together; a longer text is alone."""
    first, size = 0, 0
    for i, length in enumerate((ends - starts).tolist()):
        if size and size + length > most:
            yield first, i
            first, size = i, 0
        size += length
    if first < len(starts):
        yield first, len(starts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte value, after lower-casing A to Z.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


@functools.cache
def _all_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _all_powers(base, max(PIECE, 1 << (int(n) - 1).bit_length()))[:n]


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of ``text`` (A to Z lower-cased); starts and ends must not decrease."""
    # A polynomial over the bytes, read off prefix sums: (P[end] - P[start]) / BASE**start.
    # Spans of about PIECE bytes at a time, so that a very long text needs no more memory.
    out = np.empty(len(start), np.uint64)
    cuts = np.searchsorted(start, np.arange(PIECE, len(text), PIECE))
    for i, j in zip([0, *cuts], [*cuts, len(out)], strict=True):
        if i == j:
            continue
        low, high = start[i], end[j - 1]
        powers, inverse = _powers(_BASE, high - low), _powers(_INVERSE, high - low)
        prefix = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[text[low:high]] * powers, out=prefix[1:])
        first, last = start[i:j] - low, end[i:j] - low
        out[i:j] = mixed((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64))
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCTUATION = np.ones(128, bool)
_PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Separators under which a word is a run of ASCII letters, digits and all other characters.
LOOSE = np.concatenate([_PUNCTUATION, np.zeros(128, bool)])


class Words:
    """Words of neighbouring texts: ``hash`` (A to Z lower-cased), ``start`` and ``end`` in bytes,
    ``doc`` (number of the text) and ``first`` (for each text, its first word; one more at the end).
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray = _SPACE):
        low, high = int(starts[0]), int(ends.max())
        text = raw[low:high]
        starts, ends = starts - low, np.maximum(ends, starts) - low
        word = np.zeros(len(text) + 2, bool)
        word[1:-1] = ~gaps[text]
        edges = word[1:] != word[:-1]
        begin = edges[:-1] & word[1:-1]
        # Texts lie side by side: a word that runs into the next text is cut there.
        inner = starts[(starts > 0) & (starts < len(text))]
        begin[inner] = word[1:-1][inner]
        self.start = np.flatnonzero(begin)
        stop = edges[1:] & word[1:-1]
        stop[inner - 1] = word[1:-1][inner - 1]
        self.end = np.flatnonzero(stop) + 1
        self.hash = self._hashes(text)
        self.first = np.searchsorted(self.start, np.append(starts, len(text)))
        self.doc = np.repeat(np.arange(len(starts)), np.diff(self.first))
        self.start += low
        self.end += low

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        return span_hashes(text, self.start, self.end)


class Spans(Words):
    """Words of neighbouring texts without their hashes."""

    def _hashes(self, text: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbouring hashes (their number less ``width`` - 1)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mixed(out)


def parity_bits(hashes: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """(sets, many / 64) words: each set's hashes dealt over ``many`` bits, each bit the parity of its hashes.

    ``first`` bounds the sets, none of them empty. Sets differ in as many hashes as bits at least.
    """
    at = hashes & np.uint64(many - 1)
    one = np.uint64(1) << (at & np.uint64(63))
    words = np.zeros((len(first) - 1, many // 64), np.uint64)
    if len(words):
        for w in range(many // 64):
            words[:, w] = np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == np.uint64(w), one, np.uint64(0)), first[:-1])
    return words
