"""A wavelet matrix over token ids: bit-planes with rank and select, and its byte format.

Plane 0 holds the highest bit of every id in text order; each next plane holds
the next bit after a stable partition of the ids by the bit before (zeros
first). One id costs ``bits`` bits and a sixteenth of that for the rank directory
(ones before each block of 512 bits). Access, counting and finding all take
``bits`` steps from the planes alone.

Format, little-endian: the magic, then the header (tokens, documents, bits) as
unsigned 64-bit integers; document ids (int64) and a byte each that is 1 for a null
id; document starts (uint64, documents + 1); for each plane its number of zeros
(uint64), its bits padded to blocks of 64 bytes, its rank directory (uint64).
"""

from __future__ import annotations

import numpy as np

MAGIC = b"WAVEMTX1"
BLOCK = 512
SELECTED = 1 << 16    # places found at once


class Plane:
    def __init__(self, packed: np.ndarray, before: np.ndarray, zeros: int, n: int):
        self.packed, self.before, self.zeros, self.n = packed, before, zeros, n
        self.words = packed.view("<u8")

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n = len(bits)
        packed = np.zeros(max(1, -(-n // BLOCK)) * (BLOCK // 8), np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[:len(raw)] = raw
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))
        return cls(packed, before, n - int(before[-1]), n)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i (0 to n)."""
        block = i // BLOCK
        out = self.before[block].astype(np.int64)
        inside = i - block * BLOCK
        for k in range(BLOCK // 64):
            take = np.clip(inside - 64 * k, 0, 64)
            word = self.words[np.minimum(block * (BLOCK // 64) + k, len(self.words) - 1)]
            mask = np.where(take >= 64, ~np.uint64(0), (np.uint64(1) << (take & 63).astype(np.uint64)) - np.uint64(1))
            out += np.where(take > 0, np.bitwise_count(word & mask), 0).astype(np.int64)
        return out

    def select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        ends = np.arange(len(self.before), dtype=np.int64) * BLOCK
        before = self.before.astype(np.int64) if bit else ends - self.before.astype(np.int64)
        out = np.empty(len(k), np.int64)
        for lo in range(0, len(k), SELECTED):
            want = k[lo:lo + SELECTED]
            block = np.searchsorted(before, want, "right") - 1
            left = want - before[block]
            words = self.words[np.minimum(block[:, None] * (BLOCK // 64) + np.arange(BLOCK // 64), len(self.words) - 1)]
            words = words if bit else ~words
            upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            at = (upto <= left[:, None]).sum(axis=1)            # the word that holds it
            row = np.arange(len(want))
            left = left - np.where(at > 0, upto[row, at - 1], 0)
            bits = np.unpackbits(words[row, at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
            out[lo:lo + SELECTED] = block * BLOCK + at * 64 + inside
        return out


class WaveletMatrix:
    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            b = (now & now.dtype.type(1 << level)) != 0
            planes.append(Plane.of(b))
            now = np.concatenate((now[~b], now[b]))
        return cls(planes, len(ids))

    def all(self) -> np.ndarray:
        """Every id in text order, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level, p in enumerate(reversed(self.planes)):
            b = p.bits()
            up = np.empty_like(now)
            up[~b] = now[:p.zeros]
            up[b] = now[p.zeros:] | now.dtype.type(1 << level)
            now = up
        return now

    def access(self, i) -> np.ndarray:
        i = np.atleast_1d(np.asarray(i, np.int64))
        out = np.zeros(len(i), np.int64)
        for p in self.planes:
            b = p.get(i)
            one = p.rank1(i)
            i = np.where(b == 1, p.zeros + one, i - one)
            out = out << 1 | b
        return out

    def _follow(self, token: int, i: np.ndarray) -> np.ndarray:
        for level, p in enumerate(self.planes):
            one = p.rank1(i)
            i = p.zeros + one if token >> (self.bits - 1 - level) & 1 else i - one
        return i

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions [lo, hi)."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._follow(token, np.array([lo, self.n if hi is None else hi], np.int64))
        return int(b - a)

    def find(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Positions of ``token`` in [lo, hi), ascending: select from the lowest plane up."""
        if token < 0 or token >> self.bits:
            return np.zeros(0, np.int64)
        a, b = self._follow(token, np.array([lo, self.n if hi is None else hi], np.int64))
        i = np.arange(a, b)
        for level, p in enumerate(reversed(self.planes)):
            bit = token >> level & 1
            i = p.select(bit, i - p.zeros if bit else i)
        return i


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, null_ids: np.ndarray, starts: np.ndarray) -> bytes:
    head = np.array([matrix.n, len(doc_ids), matrix.bits], "<u8")
    parts = [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), null_ids.astype(np.uint8).tobytes(),
             starts.astype("<u8").tobytes()]
    for p in matrix.planes:
        parts += [np.array([p.zeros], "<u8").tobytes(), p.packed.tobytes(), p.before.astype("<u8").tobytes()]
    return b"".join(parts)


def from_bytes(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, document ids, null flags and document starts."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    at = 8

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out
    n, docs, bits = map(int, take("<u8", 3))
    ids, null, starts = take("<i8", docs), take("u1", docs).astype(bool), take("<u8", docs + 1).astype(np.int64)
    blocks = max(1, -(-n // BLOCK))
    planes = []
    for _ in range(bits):
        zeros = int(take("<u8", 1)[0])
        packed = np.array(take("u1", blocks * BLOCK // 8))  # a copy: aligned for 64-bit words
        planes.append(Plane(packed, take("<u8", blocks + 1), zeros, n))
    return WaveletMatrix(planes, n), ids, null, starts
