"""Sets of word shingles as 64-bit hashes, for many texts at once.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
with A-Z in lower case. A shingle is ``WORDS`` words in a row; a text with fewer words has its whole
sequence as the only one; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from copycensus.llm.common import worker_memory

WORDS = 5
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of the base and of its inverse up to ``n``."""
    memory = worker_memory()
    if len(memory.get("powers", ((),))[0]) <= n:
        size = max(n + 1, 2 * CHUNK_BYTES)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        of_byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        of_byte[65:91] = of_byte[97:123]  # A-Z count as a-z
        memory["powers"] = (np.cumprod(up), np.cumprod(down), of_byte)
    return memory["powers"]


def _chunk(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts that end at ``ends``, and how many each text has."""
    n = len(data)
    texts = len(ends)
    up, down, of_byte = _tables(n)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[ends] = True
    word = ~space
    begin = np.flatnonzero(word & (cut[:n] | np.concatenate(([True], space[:-1]))))
    end = np.flatnonzero(word & (cut[1:] | np.concatenate((space[1:], [True])))) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(of_byte[data] * up[:n], out=total[1:])
    words = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    upto = np.searchsorted(begin, ends)
    count = np.diff(upto, prepend=0)
    first = upto - count
    shingles = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    # Position of each shingle's first word.
    at = np.arange(shingles.sum()) + np.repeat(first - (np.cumsum(shingles) - shingles), shingles)
    length = np.repeat(np.minimum(count, WORDS), shingles)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    h = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(WORDS):
        factor = np.uint64((pow(0xE7037ED1A0B428DB, k + 1, 1 << 64)) & _MASK)
        h += np.where(k < length, padded[at + k] * factor, np.uint64(0))
    assert len(count) == texts
    return mix(h), shingles


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (none may be null)."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, len(texts))
        if bounds[b] == bounds[a]:
            for _ in range(b - a):
                yield np.zeros(0, np.uint64)
        else:
            h, n = _chunk(data[bounds[a] : bounds[b]], bounds[a + 1 : b + 1] - bounds[a])
            stop = np.cumsum(n)
            for i, j in zip(stop - n, stop, strict=True):
                yield np.unique(h[i:j])
        a = b
