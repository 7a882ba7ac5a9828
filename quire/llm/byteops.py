"""Vectorized work on UTF-8 text: words, rolling hashes and mixing, all in NumPy.

An Arrow string column already is one byte buffer with offsets. Everything
here runs over such buffers in slices of a bounded number of bytes (a single
longer text makes a slice of its own), so memory follows the slice and not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes in a slice.
SLICE = 1 << 20

#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A to Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of at most ``limit`` bytes, or one row."""
    buf, off = text_buffer(column)
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and where each text's words begin (length + 1).

    ``ink`` says which bytes belong to words: by default all but white space.
    """
    ink = ~SPACE[buf] if ink is None else ink
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    full = off[:-1] < off[1:]
    at = off[:-1][full]
    first[at] = ink[at]
    at = off[1:][full] - 1
    last[at] = ink[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(1 << bits, base), np.full(1 << bits, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[starts:ends], for any spans, from one prefix sum."""
    n = len(values)
    up, down = _powers(max(12, int(n).bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=prefix[1:])
    spans = prefix[ends]
    spans -= prefix[starts]
    spans *= down[starts]
    spans += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(spans)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hash(_BYTE_CODE[buf], starts, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word shingle, and where each text's shingles begin.

    A text of fewer words has its whole sequence as one shingle, one without
    words has none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(out[-1]) - np.repeat(out[:-1] - bounds[:-1], counts)
    ends = np.minimum(starts + k, np.repeat(bounds[1:], counts))
    return span_hash(hashes, starts, ends), out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def longs(array: pa.Array, null: int = 0) -> np.ndarray:
    """An integer column as int64; nulls become ``null``."""
    return pc.fill_null(array.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def binaries(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive pieces of ``data``."""
    off = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def crc_bucket(ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of the id as decimal text, modulo ``modulus``; -1 for a null id."""
    from zlib import crc32

    return np.array([-1 if i is None else crc32(str(i).encode()) % modulus for i in ids.to_pylist()], dtype=np.int64)
