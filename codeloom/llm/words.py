"""Word runs of whole columns of text as 64-bit hashes, without a Python string per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

K = np.uint64(0x9E3779B97F4A7C15)


def letters(extra: bytes = b"") -> np.ndarray:
    """Byte table of the characters of a word: ASCII letters (folded to lower case), digits and ``extra``."""
    table = np.zeros(256, dtype=np.uint64)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789" + extra:
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word run, in order; null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    count, data = len(texts), texts.buffers()[2]
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + count + 1]
    if not count or data is None or bounds[-1] == bounds[0]:
        return none
    raw = table[np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    on = raw > 0
    first = on.copy()
    first[1:] &= ~on[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] |= on[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return none
    at = np.flatnonzero(on)
    place = at - starts[np.cumsum(first)[at] - 1]
    power = np.cumprod(np.full(int(place.max()) + 1, K, dtype=np.uint64))
    hashed = mix(np.add.reduceat(raw[at] * power[place], np.flatnonzero(first[at])))
    return np.searchsorted(bounds, starts, side="right") - 1, hashed
