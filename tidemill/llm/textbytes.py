"""Vectorised views of Arrow text columns: whole texts, a few megabytes of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
#: The first k bytes of eight, for k of 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows and the end) of runs of rows of about ``most`` bytes (a pass over them takes some fifty times that); null reads as empty.

    A longer text comes alone and whole.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of the words ``[^\\x20\\x09-\\x0D]+``, and each row's first word (and the end)."""
    ink = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = ink[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased: each eight bytes are scattered with a key of their place, then their sum with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.zeros(len(data) + 8, np.uint8)
    low[: len(data)] = _LOWER[data]
    pieces = (ends - starts + 7) // 8
    first = np.cumsum(pieces) - pieces
    of = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(of)) - first[of]
    at = starts[of] + 8 * place
    value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(low, 8)[at]).view("<u8").ravel()
    value = mix64((value & _FIRST[np.minimum(ends[of] - at, 8)]) ^ mix64((place.astype(np.uint64) + np.uint64(1)) * _R))
    return mix64(np.add.reduceat(value, first) ^ mix64((ends - starts).astype(np.uint64)))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its word shingles; a shorter text is one shingle, a text without words none."""
    odd = [mix64(np.uint64([k + 1]))[0] | np.uint64(1) for k in range(width)]
    for _, data, at in slices(texts):
        starts, ends, first = words(data, at)
        w = word_hashes(data, starts, ends)
        sums = np.zeros(max(0, len(w) - width + 1), np.uint64)
        for k in range(width):
            sums += w[k : k + len(sums)] * odd[k]
        sums = mix64(sums)
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= width:
                yield np.unique(sums[lo : hi - width + 1])
            elif hi > lo:
                part = w[lo:hi] * np.array(odd[: hi - lo], np.uint64)
                yield mix64(part.sum(keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
