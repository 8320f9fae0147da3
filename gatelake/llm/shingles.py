"""Word shingles of many texts at once, in numpy.

Word hashes come from one pass over the bytes of a batch: with prefix sums P(i) of T[byte] * R**i modulo 2**64, a word
from s to e has the hash (P(e) - P(s)) * R**-s, which depends on its bytes only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space is \x09-\x0D and \x20; A-Z count as a-z. Bytes beyond ASCII stay, so UTF-8 needs no decoding.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_T = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T[65:91] = _T[97:123]
_A = [np.uint64(x) for x in (_rng.integers(1, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]
#: Bytes handled together: as many as a processor's cache holds with the arrays made of them.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_R, CHUNK), _powers(_R_INVERSE, CHUNK)


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw`` and, for each text between two ``bounds``, the number of its first word."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64)
    solid = ~SPACE[raw]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = bounds[1:-1]
    after[inner[(inner > 0)] - 1] = False
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``raw`` and, for each text between two ``bounds``, the number of its first word."""
    starts, ends, first = word_spans(raw, bounds)
    return span_hashes(raw, starts, ends), first


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    up, down = (_UP, _DOWN) if n <= CHUNK else (_powers(_R, n), _powers(_R_INVERSE, n))
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_T[raw] * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def text_chunks(texts: pa.Array, size: int = 0):
    """Texts (string or binary) in order, as many together as ``size`` (CHUNK) bytes hold and one at least: their first and last row, bytes and bounds."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (size or CHUNK), side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(texts: pa.Array, width: int):
    """For each text, in order, the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text with fewer words has one shingle of all of them; one without words, or null, has none.
    """
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    for i, j, raw, bounds in text_chunks(texts):
        words, first = word_hashes(raw, bounds)
        if len(words) >= width:
            h = words[: len(words) - width + 1] * _A[0]
            for k in range(1, width):
                h = h + words[k : len(words) - width + 1 + k] * _A[k]
            h = mix(h)
        for t in range(j - i):
            a, b = int(first[t]), int(first[t + 1])
            if a == b or not valid[i + t]:
                yield np.zeros(0, dtype=np.uint64)
            elif b - a < width:
                own = b - a
                for k in range(a, b):
                    own = (own * int(_A[15]) + int(words[k])) % (1 << 64)
                yield mix(np.array([own], dtype=np.uint64))
            else:
                yield np.unique(h[a : b - width + 1])
