"""numpy kernels over Arrow string columns: word boundaries and rolling word hashes.

Words are ``[^\\x20\\x09-\\x0D]+``: runs of bytes other than the six ASCII white-space bytes.  UTF-8
keeps every other byte of a character above 0x7F, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are handled in slices of about this many bytes, so that scratch arrays stay small.
SLICE_BYTES = 2_000_000

_RADIX = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


class _Powers:
    """Powers of an odd radix and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, radix: int) -> None:
        self.radix, self.inverse = radix, pow(radix, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([U64(1)], np.full(size - 1, self.radix, dtype=U64))).cumprod(dtype=U64)
                self.down = np.concatenate(([U64(1)], np.full(size - 1, self.inverse, dtype=U64))).cumprod(dtype=U64)
        return self.up, self.down


_POWERS = {seed: _Powers((_RADIX * (2 * seed + 1)) % 2**64) for seed in (0, 1)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of consecutive texts: ``starts`` and ``ends`` in ``data``; ``first[d]`` the number of
    the first word of text ``d``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False) -> None:
        base = int(offsets[lo])
        data = raw[base : int(offsets[hi])]
        self.data = LOWER[data] if lower else data
        offs = (offsets[lo : hi + 1] - base).astype(np.int64)
        self.offsets = offs
        n = len(self.data)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(hi - lo + 1, np.int64)
            return
        solid = ~SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, offs)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = _POWERS[seed].to(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum(_byte_table(17 + seed)[self.data] * up[:n], dtype=U64, out=total[1:])
            h = (total[self.ends] - total[self.starts]) * down[self.starts]
            return mix(h + (self.ends - self.starts).astype(U64))


def windows(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``width`` consecutive entries of ``h`` (document ends not minded)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    radix = U64((0xD6E8FEB86659FD93 * (2 * seed + 1)) % 2**64 | 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out *= radix
            out += h[k : k + n]
        return mix(out)
