"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)
#: Texts are handled in slices of about this many characters.
SLICE_CHARS = 1_000_000


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, lower-cased texts) in slices; a null counts as the empty text."""
    lo, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        if held and size + len(t) > limit:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield lo, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with a blank before and after each text, offsets of the padded texts)."""
    joined = " " + "  ".join(texts) + " "
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=offsets[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), offsets


def grams(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, of 2**bits, of the n-gram that starts at each code point (len(cp) - n + 1 of them)."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        h = cp[:m] * _MULT[0] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _MULT[k] + cp[k : k + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def per_text(cp: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[list[np.ndarray]]:
    """For each text the buckets of its n-grams, one array for each n."""
    every = [grams(cp, n, bits) for n in sizes]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield [g[a : max(a, b - n + 1)] for g, n in zip(every, sizes, strict=True)]


def aligned(cp: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram at each code point, whether it ends within its own text)."""
    g = grams(np.concatenate((cp, np.zeros(n - 1, np.uint32))), n, bits)
    own = np.ones(len(cp), dtype=bool)
    for k in range(1, n):
        own[np.maximum(offsets[1:] - k, offsets[:-1])] = False
    return g, own
