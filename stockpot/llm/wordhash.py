"""64-bit hashes of the words of whole Arrow text columns, without Python strings.

A word is a maximal run of bytes other than space and 0x09-0x0D, A-Z lower-cased.
Its hash is a polynomial in random per-byte values modulo 2**64, then mixed. Two
different words of a corpus of V words share a hash with probability about V**2 / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; temporaries take about 40 times as much.
WINDOW = 1 << 18

_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _VALUES[_LOWER]
_TABLE[_BREAK] = 0
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, WINDOW + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's start and end in them; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, prefix: int = 0, suffix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes of all words in order, number of words of each text, hashes of the first
    `prefix` or last `suffix` bytes of each word or None)."""
    data, at = text_buffer(column)
    hashes, starts, parts, pos, total = [], [], [], 0, len(data)
    while pos < total:
        end = min(pos + WINDOW, total)
        if end < total:
            border = at[np.searchsorted(at, end, "right") - 1]
            breaks = np.flatnonzero(_BREAK[data[max(pos, border) : end]])
            if len(breaks):
                end = max(pos, border) + int(breaks[-1]) + 1
            elif border > pos:
                end = int(border)
            else:  # one word longer than the window
                border = int(at[np.searchsorted(at, pos, "right")])
                breaks = np.flatnonzero(_BREAK[data[end:border]])
                end = end + int(breaks[0]) if len(breaks) else border
        b = data[pos:end]
        word = ~_BREAK[b]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = at[np.searchsorted(at, pos, "left") : np.searchsorted(at, end, "left")] - pos
        opens[inner] |= word[inner]
        closes[inner[inner > 0] - 1] |= word[inner[inner > 0] - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(s):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_TABLE[b] * _power(_BASE, len(b)), out=sums[1:])
            back = _power(_UNBASE, len(b))[s]
            hashes.append(mix((sums[e] - sums[s]) * back))
            starts.append(s + pos)
            if prefix:
                parts.append(mix((sums[np.minimum(e, s + prefix)] - sums[s]) * back + np.uint64(prefix)))
            elif suffix:
                f = np.maximum(s, e - suffix)
                parts.append(mix((sums[e] - sums[f]) * _power(_UNBASE, len(b))[f] + np.uint64(suffix)))
        pos = end
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(where, at))
    empty = np.zeros(0, np.uint64)
    return np.concatenate(hashes) if hashes else empty, counts, (np.concatenate(parts) if parts else empty) if prefix or suffix else None


def hash_of(word: str) -> int:
    """The hash of one word, as word_hashes gives it."""
    return int(word_hashes(pa.array([word]))[0][0])
