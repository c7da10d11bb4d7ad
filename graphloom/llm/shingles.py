"""Hashed word shingles of whole batches of texts, by numpy over the raw UTF-8 bytes.

Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word's hash
is a polynomial over random odd byte values modulo 2**64, taken from prefix sums, and
a shingle's hash combines the hashes of its words in order. Two different shingles
get equal hashes with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z are a-z
_MULTIPLIERS = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
#: Byte values that keep upper and lower case apart: for words as they are, and for a second hash of them.
CASED = tuple(_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits (the finalizer of splitmix64)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + (1 << 16))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            all_equal = np.full(size, base, np.uint64)
            all_equal[0] = 1
            made.append(np.cumprod(all_equal, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of the words of neighbouring texts, from the first text's first byte, and the number of words of each text."""
    first, last = begins[0], ends[-1]
    text = data[first:last]
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(begins), np.int64)
    word = ~space[text]
    opens, closes = word.copy(), np.empty(len(text) + 1, bool)
    opens[1:] &= ~word[:-1]
    edges = np.unique(begins - first)
    edges = edges[edges < len(text)]
    opens[edges] |= word[edges]
    closes[1:-1] = word[:-1] & ~word[1:]
    closes[0], closes[-1] = False, word[-1]
    inner = edges[edges > 0]
    closes[inner] |= word[inner - 1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes)
    bounds = np.searchsorted(start, np.append(begins, last) - first)
    return start, stop, np.diff(bounds)


def word_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hashes of the words of a run of bytes; ``values`` are those of the bytes."""
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _power(len(text))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(values[text] * power[: len(text)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))


def _chunk(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of neighbouring texts, and the number of words of each text."""
    start, stop, counts = word_bounds(data, begins, ends)
    return word_hashes(data[begins[0] : ends[-1]], start, stop), counts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; null ones are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of neighbouring texts of about ``CHUNK`` bytes; a longer text is a run of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to
        at = to


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes, lengths) for runs of neighbouring texts.

    ``lengths[i]`` sorted distinct hashes belong to the i-th text of the run. A text of
    fewer than five words, if it has any, has one hash for all of them.
    """
    data, offsets = text_bytes(texts)
    for at, to in runs(offsets):
        words, counts = _chunk(data, offsets[at:to], offsets[at + 1 : to + 1])
        ends = np.cumsum(counts)
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(WORDS):
            rolled += words[j : j + n] * _MULTIPLIERS[j]
        rolled = mix(rolled)
        sets, lengths = [], np.zeros(to - at, np.int64)
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if count >= WORDS:
                own = np.unique(rolled[end - count : end - WORDS + 1])
            elif count:
                own = mix((words[end - count : end] * _MULTIPLIERS[:count]).sum(dtype=np.uint64, keepdims=True), count)
            else:
                continue
            lengths[i] = len(own)
            sets.append(own)
        yield at, (np.concatenate(sets) if sets else np.empty(0, np.uint64)), lengths
