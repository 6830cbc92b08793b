"""Vectorised scans over Arrow string columns: words, word hashes, rolling n-gram hashes.

Everything works on the UTF-8 bytes of a whole column at once, so no Python loop runs per
word or per byte.  Hashes are 64-bit sums ``sum(R[byte] * B**offset)`` (R: a fixed random table),
finished with a mixing step; they are equal in every process and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHAIN = U64(0xD6E8FEB86659FD93)
CHAIN_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
#: A second, independent hash.
BASE_2, CHAIN_2 = U64(0xC2B2AE3D27D4EB4F), U64(0xA24BAED4963EE407)
BASE_2_INVERSE, CHAIN_2_INVERSE = (U64(pow(int(b), -1, 1 << 64)) for b in (BASE_2, CHAIN_2))
BYTE_CODE_2 = np.random.default_rng(20250611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes scanned at once, at about 50 bytes of memory each; a longer document is scanned alone.
BLOCK_BYTES = (1 << 19) - 64

#: words ``[^\x20\x09-\x0D]+``
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get((int(base), 0))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[(int(base), 0)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads the sums over all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (len + 1) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Row ranges (lo, hi) whose texts together have about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


class Words:
    """Words of a run of documents: byte ``start``/``end``, their row ``doc``, ``hash`` (``twice``: and ``hash_2``), and ``first`` (rows + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACE_WORD, lower: bool = False, twice: bool = False):
        n = len(offsets) - 1
        if lower:
            data = ASCII_LOWER[data]
        inside = word[data] if len(data) else np.zeros(0, bool)
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < len(data))]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = self.hashes(data, BYTE_CODE, BASE, BASE_INVERSE)
        self.hash_2 = self.hashes(data, BYTE_CODE_2, BASE_2, BASE_2_INVERSE) if twice else None

    def hashes(self, data: np.ndarray, code: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(code[data] * powers(base, len(data)), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(inverse, len(data) + 1)[self.start])

    def chained(self, second: bool = False) -> np.ndarray:
        """Sums of the chained hashes of the words before each word."""
        own, base = (self.hash_2, CHAIN_2) if second else (self.hash, CHAIN)
        total = np.zeros(len(own) + 1, U64)
        np.cumsum(own * powers(base, len(own)), out=total[1:])
        return total

    def grams(self, k: int, second: bool = False) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 words of the block have none."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        total = self.chained(second)
        return mix((total[k:] - total[:n]) * powers(CHAIN_2_INVERSE if second else CHAIN_INVERSE, n))

    def room(self) -> np.ndarray:
        """Words of the same document from each word on, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self.doc))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the position of the leftmost least value in values[i : i + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values.copy(), np.arange(len(values))
    done = 1
    while done < width:  # windows of 1, 2, 4, ... and then the rest
        step = min(done, width - done)
        a, b = best[: len(best) - step], best[step:]
        take = b < a
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, b, a)
        done += step
    return at[:n]
