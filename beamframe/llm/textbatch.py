"""Whole Arrow batches of text as one byte array: words, word hashes and shingle hashes without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {"n": 0}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES):
    """(first, last) ranges of texts of about `most` bytes each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i <= n; kept between calls."""
    if _STATE["n"] <= n:
        m = max(RUN_BYTES + 1024, n + 1)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = {"n": m, "up": np.multiply.accumulate(up), "down": np.multiply.accumulate(down)}
        if m > RUN_BYTES + 1024:
            return kept["up"], kept["down"]
        _STATE.update(kept)
    return _STATE["up"], _STATE["down"]


_TABLES = [mix(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(seed)) for seed in (11, 7919)]


def prefix_hash(data: np.ndarray, table: int = 0) -> np.ndarray:
    """H with H[e] - H[s] = base**s * hash(data[s:e])."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[table][data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and text number of each word [^\\x20\\x09-\\x0D]+."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    full = offsets[:-1] < offsets[1:]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][full]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each `size`-word shingle of A-Z-lowered words; a shorter text is one shingle, an empty one none. Repeats are kept."""
    starts, ends, text = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
    n = len(h) - size + 1
    own, out = [], []
    if n > 0:
        s = h[:n] * _STEPS[0]
        for k in range(1, size):
            s = s + h[k : k + n] * _STEPS[k]
        whole = text[:n] == text[size - 1 : size - 1 + n]
        own.append(text[:n][whole])
        out.append(mix(s[whole]))
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, len(text)])
    few = np.flatnonzero(count < size)
    if len(few):
        s = count[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(size - 1):
            has = count[few] > k
            s[has] += h[first[few[has]] + k] * _STEPS[k]
        own.append(text[first[few]])
        out.append(mix(s))
    return np.concatenate(own), np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (bounds, hashes sorted within a text)."""
    text, h = shingles(data, offsets, size)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])]
        text, h = text[new], h[new]
    return np.searchsorted(text, np.arange(len(offsets))), h
