"""Words of many texts at once: Arrow buffers in, numpy arrays out."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


try:  # where the C library can, freed memory goes back to the system after each batch: two workers share an executor's
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each text's bounds in them; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    first, count = 0, len(bounds) - 1
    while first < count:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, count)
        first = min(last, count)
    if _trim is not None:
        _trim(0)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't white space, and each text's bounds among them."""
    word = ~SPACE[data]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(seed))
    if not len(starts):
        return h
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(length, 8)]))
    left, at = np.flatnonzero(length > 8), 8
    while len(left):
        part = eight[starts[left] + at] & _MASK[np.minimum(length[left] - at, 8)]
        h[left] = mix(h[left] ^ part)
        at += 8
        left = left[length[left] > at]
    return h


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and first eight bytes of each span in one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    length = ends - starts
    return (eight[starts] & _MASK[np.minimum(length, 8)]) ^ mix(length.astype(np.uint64))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


_PHI = np.uint64(0x9E3779B97F4A7C15)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (not negative), ascending, and the place of each number among them.

    Numbers that leave room for it are sorted with their places; few distinct ones are looked up in a table by hash.
    """
    n, kind = len(x), x.dtype
    x = x.astype(np.uint64, copy=False)
    bits = n.bit_length()
    if n and int(x.max()).bit_length() + bits <= 64:
        own = (x << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        own.sort()
        value = own >> np.uint64(bits)
        new = np.concatenate([[True], value[1:] != value[:-1]])
        at = np.empty(n, np.int64)
        at[(own & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.cumsum(new) - 1
        return value[new].astype(kind), at
    found = np.sort(x)
    found = found[np.concatenate([[True], found[1:] != found[:-1]])] if n else found
    if 4 * len(found) > n:
        found, at = np.unique(x, return_inverse=True)
        return found.astype(kind), at
    shift = np.uint64(64 - max(8, (4 * len(found)).bit_length()))
    table = np.zeros(1 << (64 - int(shift)), np.int32)
    table[(found * _PHI) >> shift] = np.arange(len(found), dtype=np.int32)
    at = table[(x * _PHI) >> shift].astype(np.int64)
    other = np.flatnonzero(found[at] != x) if n else at
    at[other] = np.searchsorted(found, x[other])
    return found.astype(kind), at
