"""Hashes of words and shingles of whole texts, array at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
# Tables of powers grow by so many rows; workers whose chunks are short keep short ones.
TABLE_STEP = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
# Where words are runs of letters: all ASCII but letters is between words.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = -(-n // TABLE_STEP) * TABLE_STEP
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, bounds): texts in parts of ``size`` bytes; text first + k has the bytes
    bounds[k] to bounds[k + 1]. A text is never cut; a null one is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word goes over a bound."""
    word = ~blank[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    start[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class SpanHashes:
    """64-bit hashes of any spans of some bytes: differences of one running sum of powers."""

    def __init__(self, data: np.ndarray):
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = _VALUES[data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; for many short arrays faster than ``np.unique``."""
    hashes = np.sort(hashes)
    fresh = np.ones(len(hashes), bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
    return hashes[fresh]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased.
    A text with fewer words has its whole sequence as one; one without words has none."""
    for _, data, bounds in chunks(texts):
        data = LOWER[data]
        starts, ends = spans(data, bounds)
        words = SpanHashes(data)(starts, ends)
        first = np.searchsorted(starts, bounds)
        whole = len(words) - k + 1
        windows = mix(sum(words[j : j + whole] * _STEPS[j] for j in range(k))) if whole > 0 else words[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield distinct(windows[a : b - k + 1])
            elif b > a:
                short = np.append(words[a:b] * _STEPS[: b - a], _STEPS[40 + b - a])
                yield mix(short.sum(dtype=np.uint64, keepdims=True))
            else:
                yield words[:0]


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of a set, as signed 64-bit words: a bit is set if an odd number of hashes
    falls on it. The bits in which two bitmaps differ are at most the hashes that are in
    one of the two sets alone."""
    odd = np.bincount((hashes & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_key(hashes: np.ndarray) -> int:
    """64 bits that stand for a set of hashes, as a signed number."""
    spread = mix(hashes * _U(0xC2B2AE3D27D4EB4F))
    return int(mix(np.append(spread, _U(len(hashes))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])
