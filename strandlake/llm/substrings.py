"""Substring dedup: exact removal of repeated word windows, found by difference-cover anchors.

A window is ``WINDOW`` = 20 consecutive words of one document.  A word goes if a window that covers it has
a word sequence that also starts earlier: at a smaller doc_id, or earlier in the same document.

1. Anchors.  ``COVER`` is a difference cover modulo ``PERIOD`` = 13: for any two places i and j there is a
   shift d < 13 with (i + d) mod 13 and (j + d) mod 13 both in it.  So two equal windows of 20 words share
   an equal run of ANCHOR = 8 words that starts at a cover position in both.  Only those runs, 4 of 13, are
   hashed and dealt to buckets; the places of hashes seen twice come back.  Whole copies of a smaller id
   are left out first: all their windows are repeats, and no other verdict changes without them.
2. Extension.  Windows that hold a shared anchor are hashed as a whole (128 bits) and dealt to buckets; all
   but the first start of each sequence are repeats.
3. The words that repeats cover are removed.

Skew: equal hashes within one block of texts are settled there, so a hash reaches its bucket once a block
however many copies there are; the copies travel in rows that are dealt evenly.  Rows are packed arrays, not one
row a hash.  The number of buckets and blocks follows the bytes of text; none is capped.  The smallest id of each
repeated text is a table of its own, so that the join of a text that very many documents have can be split.

Contract: one row per input row with a non-null id.  Rows that share an id are versions of one document: a
window does not repeat itself at the same place of another version, and a place that is a repeat in one version is
removed from all that have a window there; equal rows get equal results.  Null and empty texts have no words:
n_removed 0 and the digest of the empty text.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, Words, mix, slices, string_buffers, windows
from .store import materialise, project

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text that a block of texts, and a bucket of hashes, stand for; the least number of either.
BLOCK_BYTES, BUCKET_BYTES, LEAST = 2 << 20, 32 << 20, 256

_IN_COVER = np.zeros(PERIOD, dtype=bool)
_IN_COVER[list(COVER)] = True
_PACKED = pa.schema([("key", pa.int32()), ("payload", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return doc % blocks


def _pack(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, its entries' columns one after another) for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(key[a]), b"".join([int(b - a).to_bytes(4, "little"), *(c[a:b].tobytes() for c in columns)])


def _unpack(payloads: list[bytes], dtypes: tuple[str, ...]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for p in payloads:
        n, at = int.from_bytes(p[:4], "little"), 4
        for out, d in zip(parts, dtypes, strict=True):
            size = n * np.dtype(d).itemsize
            out.append(np.frombuffer(p, d, n, at))
            at += size
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(parts, dtypes, strict=True)]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=_PACKED)


def _first_of(hashes: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first: is it the first by document and place of its hash, or the same place again; several: has its hash
    others)."""
    order = np.lexsort((pos, doc, *hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([h[order][1:] != h[order][:-1] for h in hashes])
    opener = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    same = (doc[order] == doc[order][opener]) & (pos[order] == pos[order][opener])
    first = np.zeros(len(order), dtype=bool)
    first[order] = same
    several = np.zeros(len(order), dtype=bool)
    several[order] = ~new | np.concatenate((~new[1:], [False]))
    return first, several


def _doc_slices(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, ids, row of each word, place of each word in its text)."""
    for lo, hi in slices(offsets):
        w = Words(raw, offsets, lo, hi)
        per = np.diff(w.first)
        row = np.repeat(np.arange(hi - lo), per)
        yield w, ids[lo:hi], row, np.arange(len(row)) - w.first[row]


def _anchors(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for w, own, row, place in _doc_slices(raw, offsets, ids):
        h = windows(w.hashes(), ANCHOR)
        if len(h):
            m = len(h)
            long_enough = np.diff(w.first)[row[:m]] >= WINDOW
            at = np.flatnonzero(_IN_COVER[place[:m] % PERIOD] & (row[:m] == row[ANCHOR - 1 :]) & long_enough)
            yield h[at], own[row[at]], place[at].astype(np.uint32)


#: Hash columns as they travel: 48 bits of an anchor (a chance match only adds a candidate), 96 of a window.
_WIDTH = {1: ("<u4", "<u2"), 2: ("<u8", "<u4")}


def _narrow(hashes: list[np.ndarray]) -> list[np.ndarray]:
    if len(hashes) == 1:
        return [(hashes[0] >> U64(32)).astype("<u4"), (hashes[0] >> U64(16)).astype("<u2")]
    return [hashes[0], (hashes[1] >> U64(32)).astype("<u4")]


def _deal(hashes: list[np.ndarray], doc: np.ndarray, pos: np.ndarray, buckets: int, settled_is_all: bool) -> Iterator[tuple[int, bytes]]:
    """The first of each hash to its bucket; the others, settled, to pass-through keys from ``buckets`` on.

    settled_is_all: a first that has others here is known to be shared and says so by its place's top bit.
    """
    first, several = _first_of(hashes, doc, pos)
    if settled_is_all:
        pos = np.where(first & several, pos | np.uint32(1 << 31), pos)
    f = np.flatnonzero(first)
    yield from _pack((hashes[0][f] % U64(buckets)).astype(np.int64), *_narrow([h[f] for h in hashes]), doc[f], pos[f])
    rest = np.flatnonzero(~first)
    if len(rest):
        spread = buckets + (mix(doc[rest].astype(U64) + U64(0x51ED27)) % U64(buckets)).astype(np.int64)
        yield from _pack(spread, doc[rest], pos[rest])


def _settle(key: int, payloads: list[bytes], buckets: int, blocks: int, hashes: int, first_goes: bool) -> Iterator[tuple[int, bytes]]:
    """(block, places) of what a bucket finds: repeated hashes, with (first_goes) or without their first."""
    if key >= buckets:
        doc, pos = _unpack(payloads, ("<i8", "<u4"))
    else:
        *hs, doc, pos = _unpack(payloads, (*_WIDTH[hashes], "<i8", "<u4"))
        if hashes == 1:
            hs = [hs[0].astype(U64) << U64(16) | hs[1]]
        known, pos = pos >= 1 << 31, pos & np.uint32((1 << 31) - 1)
        first, several = _first_of(hs, doc, pos)
        at = np.flatnonzero(several | known if first_goes else ~first)
        doc, pos = doc[at], pos[at]
    yield from _pack(block_of(doc, blocks), doc, pos)


def _by_doc(payloads: list[bytes]) -> dict[int, np.ndarray]:
    doc, pos = _unpack(payloads, ("<i8", "<u4"))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    return {int(doc[a]): np.unique(pos[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a}


def _candidates(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray, shared: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The windows that hold a shared anchor: (hash, second hash, document, start)."""
    wanted = np.flatnonzero(np.isin(ids, np.fromiter(shared, np.int64, len(shared))))
    if not len(wanted):
        return
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(raw)).take(pa.array(wanted))
    for w, own, row, place in _doc_slices(*string_buffers(texts), ids[wanted]):
        n = len(row)
        if n < WINDOW:
            continue
        m = n - WINDOW + 1
        mark = np.zeros(n + 1, np.int64)
        for d, doc in enumerate(own):
            a = shared[int(doc)] + w.first[d]
            a = a[a < w.first[d + 1]]
            np.add.at(mark, np.maximum(a - (PERIOD - 1), w.first[d]), 1)
            np.add.at(mark, a + 1, -1)
        at = np.flatnonzero((np.cumsum(mark)[:m] > 0) & (row[:m] == row[WINDOW - 1 :]))
        if len(at):
            yield windows(w.hashes(0), WINDOW, 0)[at], windows(w.hashes(1), WINDOW, 1)[at], own[row[at]], place[at].astype(np.uint32)


def _finish(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray, repeats: dict[int, np.ndarray], copied: np.ndarray, texts: bool) -> tuple[list, ...]:
    n_words, n_removed, digest, kept_text = [], [], [], []
    row = -1
    for w, own, _, _ in _doc_slices(raw, offsets, ids):
        for d, doc in enumerate(own):
            a, b = int(w.first[d]), int(w.first[d + 1])
            n, found = b - a, repeats.get(int(doc))
            row += 1
            if copied[row] and n >= WINDOW:
                kept, gone = b"", n
            elif found is None:
                kept = b" ".join(w.data[w.offsets[d] : w.offsets[d + 1]].tobytes().split())
                gone = 0
            else:
                found = found[found <= n - WINDOW]
                cover = np.zeros(n + 1, np.int64)
                cover[found] += 1
                cover[found + WINDOW] -= 1
                stay = np.flatnonzero(np.cumsum(cover[:n]) == 0) + a
                kept = b" ".join([w.data[s:e].tobytes() for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)])
                gone = n - len(stay)
            n_words.append(n)
            n_removed.append(gone)
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode("utf-8", "replace") if texts else None)
    return n_words, n_removed, digest, kept_text


def _prime_from(n: int) -> int:
    """The least prime of at least ``n``: ids with a common factor still spread over all blocks."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def exact_copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, h1) of the texts that a smaller id also has; ``keyed`` holds (doc_id, h1, h2), hashes of whole texts."""
    first = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").drop("last")
    return keyed.join(materialise(first, "firsts", narrow=True), ["h1", "h2"]).where("doc_id <> first").select("doc_id", "h1").distinct()


def _copied(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Which rows of ``left`` (doc_id, h1, ...) are among the copies ``right`` (doc_id, h1)."""
    known = set(zip(right["copy"].to_pylist(), right["h1"].to_pylist(), strict=True)) if right.num_rows else set()
    return np.array([pair in known for pair in zip(left["doc_id"].to_pylist(), left["h1"].to_pylist(), strict=True)], dtype=bool)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """RESULT for every row of ``docs``; ``kept_text`` is filled if ``texts``."""
    docs = project(docs, id_col, text_col).where("doc_id IS NOT NULL")
    keyed = materialise(docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("bytes")), "keyed", narrow=True)
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    blocks, buckets = _prime_from(max(LEAST, total // BLOCK_BYTES)), max(LEAST, total // BUCKET_BYTES)

    def find_anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            left = left.filter(pa.array(~_copied(left, right)))
        found = list(_anchors(*string_buffers(left["text"]), left["doc_id"].to_numpy())) if left.num_rows else []
        if not found:
            return _PACKED.empty_table()
        h, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_batches([_batch(list(_deal([h], doc, pos, buckets, True)))])

    def settle(hashes: int, first_goes: bool):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            rows = list(_settle(key[0].as_py(), group["payload"].to_pylist(), buckets, blocks, hashes, first_goes))
            return pa.Table.from_batches([_batch(rows)])

        return run

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _PACKED.empty_table()
        ids = left["doc_id"].to_numpy()
        found = list(_candidates(ids, *string_buffers(left["text"]), _by_doc(right["payload"].to_pylist())))
        if not found:
            return _PACKED.empty_table()
        h1, h2, doc, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_batches([_batch(list(_deal([h1, h2], doc, pos, buckets, False)))])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        ids = left["doc_id"].to_numpy() if left.num_rows else np.zeros(0, np.int64)
        if left.num_rows:
            found = _by_doc([x for x in right["payload"].to_pylist() if x is not None]) if right.num_rows else {}
            out = _finish(ids, *string_buffers(left["text"]), found, _copied(left, right), texts)
        return pa.table([pa.array(ids), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    packed = "key int, payload binary"
    block = F.pmod("doc_id", F.lit(blocks)).cast("int").alias("key")
    copies = materialise(exact_copies(keyed), "copies", narrow=True).select(block, F.col("doc_id").alias("copy"), "h1")
    # One plan to the end: the texts are dealt to blocks once, and the same exchange is read three times.
    blocked = docs.select(block, "doc_id", "text", F.xxhash64("text").alias("h1"))
    anchors = blocked.groupBy("key").cogroup(copies.groupBy("key")).applyInArrow(find_anchors, packed)
    shared = anchors.groupBy("key").applyInArrow(settle(1, True), packed)
    starts = blocked.groupBy("key").cogroup(shared.groupBy("key")).applyInArrow(extend, packed)
    none = F.lit(None).cast("long")
    repeats = starts.groupBy("key").applyInArrow(settle(2, False), packed).withColumns({"copy": none, "h1": none})
    repeats = repeats.unionByName(copies.select("key", F.lit(None).cast("binary").alias("payload"), "copy", "h1"))
    return blocked.groupBy("key").cogroup(repeats.groupBy("key")).applyInArrow(finish, RESULT).hint("rebalance")


def digest_query(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = f"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
starts AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS h FROM words, unnest(range(1, len(w) - {WINDOW - 2})) AS t(s)),
repeats AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM repeats, unnest(range({WINDOW})) AS t(k)),
each AS (SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(i)),
left_ AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words LEFT JOIN left_ ON left_.doc_id = words.doc_id"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """The same by a plain dictionary of word sequences, for tests."""
    seen: dict[tuple, tuple[int, int]] = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    out = {}
    for i in sorted(words):
        w, gone = words[i], set()
        for s in range(len(w) - WINDOW + 1):
            if seen.setdefault(tuple(w[s : s + WINDOW]), (i, s)) != (i, s):
                gone |= set(range(s, s + WINDOW))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept).hexdigest()
    return out
