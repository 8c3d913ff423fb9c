"""Quality rules: word statistics, then compression bands.

The zstandard ratio (compressed over raw bytes) of a whole text falls with its length for prose; text made
of few symbols, one template or repeated lines compresses better than prose of that length, and encoded or
random data worse.  A text is rejected if its ratio leaves the band of its length class, or if more than
``BAD_SHARE`` of its fixed chunks leave the chunk band (so that a junk region in a long text shows).  What is left
after the last whole chunk counts as a chunk from ``LEAST_CHUNK`` bytes on, by the band of its own length.

Contract: one row per input row, whole texts.  A null or empty text has no words: all counts 0,
``base_failed`` true, ``kept`` false, ratios null.  Repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .kernels import SPACE, U64, Words, slices, string_buffers, windows
from .store import project

LEVEL = 3
CHUNK_BYTES = 2048
CHUNK_BAND = (0.445, 0.75)
LEAST_CHUNK = 512
BAD_SHARE = 0.25
#: (bytes from, least ratio, greatest ratio): fixed limits by length.
BANDS = (
    (0, 0.0, 9.9),
    (128, 0.30, 1.05),
    (256, 0.45, 0.90),
    (512, 0.46, 0.82),
    (1024, 0.46, 0.75),
    (2048, 0.445, 0.72),
    (4096, 0.425, 0.70),
    (8192, 0.405, 0.70),
    (16384, 0.39, 0.70),
    (32768, 0.375, 0.70),
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunks long, n_chunks long"

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_FROM = np.array([b[0] for b in BANDS])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """For each text the words covered by windows of ``width`` words that occur twice or more in it."""
    n_docs, n = len(words.first) - 1, len(words.starts)
    if n < width:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), np.diff(words.first))
    m = n - width + 1
    inside = np.flatnonzero(doc[:m] == doc[width - 1 :])
    with np.errstate(over="ignore"):
        key = windows(words.hashes(), width)[inside] ^ (doc[inside].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    at = inside[twice]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return _sums((np.cumsum(cover[:n]) > 0).astype(np.int64), words.first)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _band(size: int) -> tuple[float, float]:
    """(least, greatest) ratio of a text of ``size`` bytes."""
    _, low, high = BANDS[int(np.searchsorted(_FROM, size, side="right")) - 1]
    return low, high


def _verdict(text: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio, chunks out of band, chunks, in band)."""
    n = len(text)
    if not n:
        return 0.0, 0, 0, False
    ratio = len(squeeze.compress(text)) / n
    low, high = _band(n)
    bad = chunks = 0
    for k in range(0, n, CHUNK_BYTES) if n >= CHUNK_BYTES else ():
        part = text[k : k + CHUNK_BYTES]
        if len(part) >= LEAST_CHUNK:
            least, greatest = CHUNK_BAND if len(part) == CHUNK_BYTES else _band(len(part))
            chunks += 1
            bad += not least <= len(squeeze.compress(part)) / len(part) <= greatest
    return ratio, bad, chunks, low <= ratio <= high and bad <= BAD_SHARE * chunks


def _rows(raw: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    for lo, hi in slices(offsets):
        w = Words(raw, offsets, lo, hi)
        n_words = np.diff(w.first)
        letters = _sums((~SPACE[w.data] & ((w.data & 0xC0) != 0x80)).astype(np.int64), w.offsets)
        symbols = _sums(_SYMBOL[w.data], w.offsets)
        repeats = repeated_words(w)
        texts = [w.data[a:b].tobytes() for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        dup = [duplicate_lines(t) for t in texts]
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        told = [_verdict(t, squeeze) for t in texts]
        kept = ~failed & np.array([v[3] for v in told], dtype=bool)
        yield pa.record_batch(
            [ids.slice(lo, hi - lo), pa.array(n_words), pa.array(letters), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeats), pa.array(failed), pa.array(kept)]
            + [pa.array([v[0] if v[2] or len(t) else None for v, t in zip(told, texts, strict=True)], pa.float64()), pa.array([v[1] for v in told], pa.int64()), pa.array([v[2] for v in told], pa.int64())],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ratios and verdict of every row of ``docs`` (see SCHEMA)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(*string_buffers(batch["text"]), batch["doc_id"])

    return project(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged: one pass over the text, without a join."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            for part in _rows(*string_buffers(batch["text"]), ids):
                at = part["doc_id"].filter(part["kept"])
                if len(at):
                    yield batch.select(names).take(at)

    return docs.mapInArrow(run, docs.schema)
