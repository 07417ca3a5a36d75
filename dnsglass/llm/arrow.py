"""Arrow / numpy helpers shared by the operators: text buffers without copies,
byte hashes and streaming over sorted rows."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text is worked on in pieces of about this many bytes, so that the 8-byte
#: arrays made from it stay small however large an Arrow batch is.
CHUNK_BYTES = 1 << 20


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column: row i is data[offsets[i]:offsets[i+1]];
    null and empty rows have length 0."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.string()), np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null slot may span bytes
        size = np.diff(offsets)
        size[np.asarray(col.is_null())] = 0
        if size.sum() != offsets[-1] - offsets[0]:
            return string_bytes(col.fill_null(""))
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes; a row over the limit is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept for ordinary sizes)."""
    size = max(1 << 16, 1 << int(n - 1).bit_length())
    if size not in _powers:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, U64)
            step = 1
            while step < size:
                p[step:2 * step] = p[:step] * U64(pow(base, step, 1 << 64))
                step *= 2
            made.append(p)
        if size > 4 * CHUNK_BYTES:
            return tuple(made)
        _powers[size] = tuple(made)
    return _powers[size]


class ByteHash:
    """64-bit hashes of any substrings of one byte array, by prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        pw, self.inv = _pows(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * pw[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (end - start).astype(U64) * U64(0x632BE59BD9B4E019))


def table_of(seed: int) -> np.ndarray:
    """Another byte table, for an independent hash."""
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def batches(rows: pa.Table | pa.RecordBatch, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    if isinstance(rows, pa.RecordBatch):
        rows = pa.Table.from_batches([rows])
    yield from rows.cast(schema).to_batches(max_chunksize=size)


def release() -> None:
    """Gives freed memory back to the system; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def task(f):
    """f for mapInArrow, with memory given back when a task ends."""
    def run(it):
        try:
            yield from f(it)
        finally:
            release()
    return run


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... size[i] values each, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - first, size)
