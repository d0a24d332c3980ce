"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MUL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
#: Bytes that are hashed at a time, which bounds the temporary arrays.
SLICE = 1 << 20


def release() -> None:
    """Give freed memory back to the system; Python workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def _hash_slice(part: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``part``; ``first`` holds the positions where a text begins."""
    solid = ~_SPACE[part]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    inner = first[(first > 0) & (first < len(part))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(at):
        return at, np.zeros(0, np.uint64)
    size = to - at
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    chars = _LOWER[part[solid]] + np.uint64(1)
    total = np.add.reduceat(chars * _powers(int(size.max()))[place], np.cumsum(size) - size)
    return at, mix(total ^ (size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words of all texts in order, offsets by text).

    Lower case changes A-Z only; words are maximal runs without \\x20 and \\x09-\\x0D.
    """
    data, off = buffers(column)
    lo, hi = int(off[0]), int(off[-1])
    starts, hashes = [], []
    while lo < hi:
        to = min(hi, lo + SLICE)
        if to < hi:
            k = int(np.searchsorted(off, to, side="right")) - 1
            if off[k] > lo:  # whole texts
                to = int(off[k])
            else:  # a part of one long text, up to a space
                end = int(off[k + 1])
                spaces = np.flatnonzero(_SPACE[data[lo:to]])
                if len(spaces):
                    to = lo + int(spaces[-1]) + 1
                else:
                    more = np.flatnonzero(_SPACE[data[to:end]])
                    to = to + int(more[0]) + 1 if len(more) else end
        a, b = np.searchsorted(off, [lo, to])
        at, h = _hash_slice(data[lo:to], off[a : b + 1] - lo)
        starts.append(at + lo)
        hashes.append(h)
        lo = to
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of ``width``-word shingles of each text.

    A text with fewer words has one shingle, the whole sequence; without words it has none.
    """
    words, off = word_hashes(column)
    mul = _MUL[:width]
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * mul[k]
    full = mix(full + np.uint64(width))
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        if e - s >= width:
            yield np.unique(full[s : e - width + 1])
        elif e > s:
            yield mix(np.array([(words[s:e] * mul[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` with about ``most`` bytes each; a longer text has its own."""
    _, off = buffers(column)
    k, n = 0, len(column)
    while k < n:
        to = max(k + 1, int(np.searchsorted(off, off[k] + most, side="right")) - 1)
        yield k, min(n, to)
        k = to


def blank_words(column: pa.Array, lines: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word in text order, offsets by text) of texts split at blanks.

    Empty words count. lines: line feeds split as blanks do. Null counts as the empty text.
    """
    data, off = buffers(column)
    data = data[off[0] : off[-1]]
    if lines and len(data):
        data = np.where(data == 10, np.uint8(32), data)
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((off - off[0]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()


def gather(parts: list[bytes], index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, offsets by text), where ``parts`` has the 32-bit ids of each word."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), np.uint32)
    start = np.cumsum(size) - size
    n = size[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start[index] - ends[:-1], n)
    at += np.arange(len(at))
    return flat[at], ends[offsets]
