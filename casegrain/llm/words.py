"""Words of Arrow text columns as numpy arrays: spans and 64-bit hashes, batch by batch.

All work is on the UTF-8 bytes of a column, without a Python object per word.
Separators are ASCII, so words never cut a multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# Words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOW = _BYTE[LOWER]
_STEP = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_POW = _powers(_BASE, _STEP)
_FAR = pow(_BASE, _STEP, 1 << 64)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, wide)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the index of each row's first word (rows + 1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = inside[data]
    cut = offs[(offs > 0) & (offs < n)]
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    before[cut] = False
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True,
           first: int | None = None) -> np.ndarray:
    """64-bit hash of each word's bytes (A-Z lower-cased), or of its first ``first`` bytes."""
    table = _BYTE_LOW if lower else _BYTE
    lengths = ends - starts
    if first is not None:
        lengths = np.minimum(lengths, first)
    out = np.empty(len(starts), np.uint64)
    total = np.concatenate(([0], np.cumsum(lengths)))
    for lo, hi in slices(total):
        own = lengths[lo:hi]
        begin = total[lo:hi] - total[lo]
        pos = np.arange(total[hi] - total[lo]) - np.repeat(begin, own)
        value = table[data[np.repeat(starts[lo:hi], own) + pos]]
        if own.max() > _STEP:
            far = _powers(_FAR, int(own.max()) // _STEP + 1)
            value *= _POW[pos % _STEP] * far[pos // _STEP]
        else:
            value *= _POW[pos]
        out[lo:hi] = np.add.reduceat(value, begin)
    return mix(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
