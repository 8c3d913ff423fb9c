"""Per-base work on contigs, over overlapping tiles.

A contig is cut to cores of ``core`` bases, each with ``halo`` bases on either side, which are dealt out by contig
and place, so that a chromosome spreads over as many tasks as it has tiles.  Whatever looks at most ``halo``
bases away is computed within one tile: the bases travel once, nothing that is found in them does, and memory is
bounded by the tile, not the contig.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import piece
from ..sources.derived import windows_sql

CORE = 65536
#: Bases as numbers: fixed values.
CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    CODE[_b] = _i


def tiles(contigs: DataFrame, halo: int, core: int = CORE) -> DataFrame:
    """(ci, len, core_start, core_end, from, seq, ...): ``seq`` starts at ``from`` and covers core and halos."""
    others = [c for c in contigs.columns if c not in ("ci", "len", "seq")]
    starts = contigs.select("ci", "len", "seq", *others, F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(core).cast("long"))).alias("core_start"))
    begin = F.greatest(F.col("core_start") - halo, F.lit(0))
    end = F.least(F.col("core_start") + core + halo, F.col("len"))
    rows = starts.select("ci", "len", "core_start", F.least(F.col("core_start") + core, F.col("len")).alias("core_end"), begin.alias("from"), piece(F.col("seq"), begin, end).alias("seq"), *others)
    # A contig is one row: without this all of its tiles would be one task's work.
    return rows.repartition("ci", "core_start")


def per_tile(tiled: DataFrame, kernel: Callable[[np.ndarray, int, int, int, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows (ci, pos, ...) of ``kernel(bases, from, core_start, core_end, len)``, which returns columns with ``pos``."""
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, dict[str, np.ndarray]]] = []
            size = 0
            for ci, n, a, b, at, seq in zip(*(batch[c].to_pylist() for c in ("ci", "len", "core_start", "core_end", "from", "seq")), strict=True):
                out = kernel(CODE[np.frombuffer(seq.encode(), np.uint8)], at, a, b, n)
                held.append((ci, out))
                size += len(out["pos"])
                if size > 200_000:
                    yield _rows(held, names)
                    held, size = [], 0
            if size:
                yield _rows(held, names)

    return tiled.mapInArrow(run, schema)


def _rows(held: list[tuple[int, dict[str, np.ndarray]]], names: list[str]) -> pa.RecordBatch:
    ci = np.concatenate([np.full(len(o["pos"]), c, np.int64) for c, o in held])
    return pa.record_batch([pa.array(ci), *[pa.array(np.concatenate([o[n] for _, o in held])) for n in names]], ["ci", *names])


def _prefix(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def context_codes(x: np.ndarray) -> np.ndarray:
    """The context code at each base of ``x``, 0 where undefined; two bases at either end are needed to be sure."""
    y = np.concatenate(([4, 4], x, [4, 4])).astype(np.int8)
    m2, m1, c, p1, p2 = (y[k : k + len(x)] for k in range(5))
    code = np.zeros(len(x), np.int32)
    plus, minus = c == 1, c == 2
    code[plus & (p1 == 2)] = 1
    h = plus & (p1 != 2) & (p1 < 4)
    code[h & (p2 == 2)] = 3
    code[h & (p2 != 2) & (p2 < 4)] = 7
    code[minus & (m1 == 1)] = 9
    h = minus & (m1 != 1) & (m1 < 4)
    code[h & (m2 == 1)] = 11
    code[h & (m2 != 1) & (m2 < 4)] = 15
    return code


def contexts(contigs: DataFrame) -> DataFrame:
    """(ci, pos, code): every classified cytosine of either strand."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        code = context_codes(x)
        pos = np.flatnonzero(code[a - at : b - at]) + a
        return {"pos": pos.astype(np.int64), "code": code[pos - at]}

    return per_tile(tiles(contigs, 2), kernel, "ci long, pos long, code int")


CONTEXTS_SQL = f"""{windows_sql('bases', 'contigs', 'ci', 5, '--')},
contexts AS (SELECT * FROM (SELECT ci, pos, CAST(CASE WHEN regexp_matches(near, '^..CG') THEN 1 WHEN regexp_matches(near, '^..C[ACT]G') THEN 3 WHEN regexp_matches(near, '^..C[ACT][ACT]') THEN 7
  WHEN regexp_matches(near, '^.CG') THEN 9 WHEN regexp_matches(near, '^C[AGT]G') THEN 11 WHEN regexp_matches(near, '^[AGT][AGT]G') THEN 15 END AS INTEGER) AS code FROM bases) WHERE code IS NOT NULL)"""


def valid_places(x: np.ndarray, at: int, a: int, b: int, n: int, read: int, insert: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, GC counts) of the tile's starts whose insert fits and whose reads have at most ``max_n`` N each."""
    last = min(b, n - insert + 1)
    if last <= a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unknown, gc = _prefix(x == 4), _prefix((x == 1) | (x == 2))
    s = np.arange(a, last) - at
    s = s[(unknown[s + read] - unknown[s] <= max_n) & (unknown[s + insert] - unknown[s + insert - read] <= max_n)]
    return (s + at).astype(np.int64), gc[s + insert] - gc[s]


def valid_starts(contigs: DataFrame, read: int, insert: int, max_n: int) -> DataFrame:
    """(ci, pos, gc): every valid start, for plans that need each place."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        pos, gc = valid_places(x, at, a, b, n, read, insert, max_n)
        return {"pos": pos, "gc": gc}

    return per_tile(tiles(contigs, insert), kernel, "ci long, pos long, gc long")


def valid_runs(contigs: DataFrame, read: int, insert: int, max_n: int) -> DataFrame:
    """(ci, pos, stop): runs of consecutive valid starts within each tile."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        pos, _ = valid_places(x, at, a, b, n, read, insert, max_n)
        opens = np.flatnonzero(np.diff(pos, prepend=-2) != 1) if len(pos) else np.zeros(0, np.int64)
        closes = np.concatenate((opens[1:], [len(pos)])) - 1 if len(pos) else opens
        return {"pos": pos[opens], "stop": pos[closes] + 1}

    return per_tile(tiles(contigs, insert), kernel, "ci long, pos long, stop long")


def start_counts(contigs: DataFrame, read: int, insert: int, max_n: int, core: int = CORE) -> DataFrame:
    """(ci, pos, n): the number of valid starts of the tile that begins at ``pos``."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        pos, _ = valid_places(x, at, a, b, n, read, insert, max_n)
        return {"pos": np.array([a], np.int64), "n": np.array([len(pos)], np.int64)}

    return per_tile(tiles(contigs, insert, core), kernel, "ci long, pos long, n long").where("n > 0")


def gc_counts(contigs: DataFrame, read: int, insert: int, max_n: int, bins: int) -> DataFrame:
    """(ci, pos, n): valid starts of each tile by GC bin (``pos`` is the bin), halves rounded up."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        _, gc = valid_places(x, at, a, b, n, read, insert, max_n)
        found, count = np.unique(gc * (bins - 1) // insert + (gc * (bins - 1) % insert * 2 >= insert), return_counts=True)
        return {"pos": found.astype(np.int64), "n": count.astype(np.int64)}

    return per_tile(tiles(contigs, insert), kernel, "ci long, pos long, n long")


def starts_at(contigs: DataFrame, draws: DataFrame, read: int, insert: int, max_n: int, core: int = CORE) -> DataFrame:
    """(ci, candidate, ordinal, rank, start, gc) of ``draws`` (ci, tile, rest, candidate, ordinal, rank).

    A draw wants the ``rest``-th valid start of its tile. The draws of a tile travel as one list (as many as
    fall on 64 KiB); starts that nobody draws are never rows.
    """
    lists = draws.groupBy("ci", "tile").agg(F.collect_list(F.struct("rest", "candidate", "ordinal", "rank")).alias("picks"))
    rows = tiles(contigs, insert, core).withColumn("tile", (F.col("core_start") / core).cast("long")).join(lists, ["ci", "tile"])
    rows = rows.select("ci", "len", "core_start", "core_end", "from", "seq", *[F.col(f"picks.{c}").alias(c) for c in ("rest", "candidate", "ordinal", "rank")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ci, n, a, b, at, seq = (batch[c][k].as_py() for c in ("ci", "len", "core_start", "core_end", "from", "seq"))
                pos, gc = valid_places(CODE[np.frombuffer(seq.encode(), np.uint8)], at, a, b, n, read, insert, max_n)
                rest, candidate, ordinal, rank = (batch[c][k].values for c in ("rest", "candidate", "ordinal", "rank"))
                yield pa.record_batch([pa.array(np.full(len(rest), ci, np.int64)), candidate, ordinal, rank, pa.array(pos[rest.to_numpy()]), pa.array(gc[rest.to_numpy()])], ["ci", "candidate", "ordinal", "rank", "start", "gc"])

    return rows.mapInArrow(run, "ci long, candidate long, ordinal long, rank long, start long, gc long")


def valid_starts_sql(read: int, insert: int, max_n: int, name: str = "starts") -> str:
    return f"""{windows_sql(name + '_whole', 'contigs', 'ci', insert)}, {name} AS (SELECT ci, pos, CAST({insert} - length(translate(near, 'CG', '')) AS BIGINT) AS gc FROM {name}_whole
  WHERE {read} - length(replace(substr(near, 1, {read}), 'N', '')) <= {max_n} AND {read} - length(replace(substr(near, {insert - read + 1}, {read}), 'N', '')) <= {max_n})"""


def cuts_in(x: np.ndarray, sites: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, motifs that cut there) of the bases ``x``, in order."""
    found = [np.zeros(0, np.int64)]
    for motif, cut in sites:
        m = len(x) - len(motif) + 1
        if m <= 0:
            continue
        hit = np.ones(m, bool)
        for k, base in enumerate(CODE[np.frombuffer(motif.encode(), np.uint8)]):
            hit &= (x[k : k + m] < 4) if base == 4 else (x[k : k + m] == base)
        found.append(np.flatnonzero(hit) + cut)
    pos, count = np.unique(np.concatenate(found), return_counts=True)
    return pos.astype(np.int64), count.astype(np.int64)


def cut_places(contigs: DataFrame, sites: list[tuple[str, int]]) -> DataFrame:
    """(ci, pos, sites): distinct cut positions and how many recognised motifs cut there.

    Motifs overlap freely; N in a motif stands for any of A, C, G, T but never for an N of the contig.
    """
    longest = max(len(m) for m, _ in sites)

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int) -> dict[str, np.ndarray]:
        pos, count = cuts_in(x, sites)
        pos = pos + at
        # The core owns its cuts; the contig's end belongs to the last core.
        own = (pos >= a) & ((pos < b) | ((pos == n) & (b == n)))
        return {"pos": pos[own], "sites": count[own]}

    return per_tile(tiles(contigs, longest), kernel, "ci long, pos long, sites long")


def per_tile_keyed(tiled: DataFrame, kernel: Callable, seed: int, stage: int, schema: str) -> DataFrame:
    """``per_tile`` for kernels that draw: they get the contig's key of a stage as well."""
    from ..functions import philox as rng

    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ci, n, a, b, at, seq in zip(*(batch[c].to_pylist() for c in ("ci", "len", "core_start", "core_end", "from", "seq")), strict=True):
                key = rng.stage_key(seed, stage, np.array([ci]))
                out = kernel(CODE[np.frombuffer(seq.encode(), np.uint8)], at, a, b, n, key)
                if len(out["pos"]):
                    yield _rows([(ci, out)], names)

    return tiled.mapInArrow(run, schema)
