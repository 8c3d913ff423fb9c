"""Fragments to reads: sites, methylation states, conversion, mates, qualities, errors and records.

Fragments meet the tile of the reference that holds them, together with the levels that are given there
and, on haplotypes, the events.  Contexts, levels, states, conversion and reads are one numpy pass over a
tile's fragments: sites and bases are never rows, and only picks, given levels and events are shuffled.
Draws are addressed by the fragment's global ordinal, so tiles and chunks can be of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import philox as rng
from ..functions import samplers
from ..functions import seq as sq
from ..sources import derived as src
from . import haplotiles, sqlgen, tiles
from .basics import DEFAULTS, INSERT, READ, SEED, Params
from .libraries import UNIFORM_SQL, wgbs_uniform
from .registry import query
from .variation import DEFAULT

CONVERSION_RATE, ERROR_RATE, PHRED = DEFAULTS.conversion, DEFAULTS.error, DEFAULTS.phred
CORE = 16384


@dataclass(frozen=True)
class Options:
    """How reads are made, beside the parameters of the draws; the defaults are those of the registered queries."""

    paired: bool = True
    directional: bool = False
    #: Count models of qualities and of errors that depend on them; else uniform ones.
    quality: dict | None = None
    confusion: dict | None = None
    #: (seed, ci, ordinal, site_index, level) -> methylated.
    states: Callable[..., np.ndarray] | None = None
    #: Details of alignments: states, summaries, projections.
    details: bool = True


def fragment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_fragments(src.contigs(spark, sf_dir), wgbs_uniform(spark, sf_dir), DEFAULTS)


def cut_fragments(c: DataFrame, picked: DataFrame, p: Params) -> DataFrame:
    """(ordinal, ci, name, start, template) of the picked starts: each meets the tile that holds it."""
    tiled = tiles.tiles(c, p.insert, CORE).select("ci", "name", (F.col("core_start") / CORE).cast("long").alias("tile"), "from", F.col("seq").alias("around"))
    rows = picked.withColumn("tile", F.floor(F.col("start") / CORE)).join(tiled, ["ci", "tile"])
    return rows.select("ordinal", "ci", "name", "start", sq.piece(F.col("around"), F.col("start") - F.col("from"), F.col("start") - F.col("from") + p.insert).alias("template"))


FRAGMENTS_SQL = f"""{UNIFORM_SQL}, fragments AS (SELECT ordinal, p.ci, name, "start" AS st, substr(seq, CAST("start" + 1 AS INTEGER), {INSERT}) AS template FROM picked p JOIN contigs USING (ci))"""


@query(f'WITH {FRAGMENTS_SQL} SELECT ordinal, ci, st AS "start", template FROM fragments')
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_table(spark, sf_dir).select("ordinal", "ci", "start", "template")


@query(f"""WITH {FRAGMENTS_SQL}, places AS (SELECT ordinal, i FROM fragments, unnest(range({INSERT})) AS t(i) WHERE substr(template, CAST(i + 1 AS INTEGER), 1) = 'N') SELECT ordinal, count(*) AS n, string_agg(i, ',' ORDER BY i) AS offsets FROM places GROUP BY ordinal""")
def original_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of unknown bases in the templates that have any, before errors can make others."""
    rows = fragment_table(spark, sf_dir).where(F.contains("template", F.lit("N")))
    places = F.filter(F.transform(F.split("template", ""), lambda c, i: F.when(c == "N", i)), lambda i: i.isNotNull())
    return rows.select("ordinal", places.alias("p")).select("ordinal", F.size("p").cast("long").alias("n"), F.array_join(F.col("p").cast("array<string>"), ",").alias("offsets"))


def placed(contigs: DataFrame, picked: DataFrame, levels: DataFrame | None, longest: int, events: DataFrame | None = None) -> DataFrame:
    """Tiles of ``contigs`` with what falls on them: ``picks``, ``levels`` and ``events``.

    ``picked`` has (ordinal, ci, start, span) and may have haplotype (0 or 1; the reference without) and strand
    (1 forward, 2 reverse, 0 unknown).  ``longest`` bounds the spans.  A list is bounded by what one tile holds.
    """
    halo = longest + 2
    tiled = haplotiles.tiled(contigs, events, halo, CORE) if events is not None else tiles.tiles(contigs, halo, CORE).withColumn("tile", F.floor(F.col("core_start") / CORE)).withColumn("events", F.lit(None).cast("array<struct<ref_start:long,ref_end:long,alt_bases:string,mask:int>>"))
    has = lambda c, kind: (F.col(c) if c in picked.columns else F.lit(None)).cast(kind).alias(c)
    picks = picked.select("ordinal", "ci", "start", "span", has("haplotype", "int"), has("strand", "int"))
    picks = picks.groupBy("ci", F.floor(F.col("start") / CORE).alias("tile")).agg(F.collect_list(F.struct("ordinal", "start", "span", "haplotype", "strand")).alias("picks"))
    tiled = tiled.join(picks, ["ci", "tile"])
    if levels is None:
        return tiled.withColumn("levels", F.lit(None).cast("array<struct<pos:long,code:int,level:double,hap:int>>"))
    hap = (F.col("hap") if "hap" in levels.columns else F.lit(None)).cast("int").alias("hap")
    # A level also belongs to the tile before, whose last fragments reach it, and to the one after.
    near = F.sequence(F.floor(F.greatest(F.col("pos") - halo, F.lit(0)) / CORE), F.floor((F.col("pos") + 2) / CORE))
    given = levels.where("level IS NOT NULL").select("ci", F.struct("pos", F.col("code").cast("int").alias("code"), F.col("level").cast("double").alias("level"), hap).alias("l"), F.explode(near).alias("tile"))
    return tiled.join(given.groupBy("ci", "tile").agg(F.collect_list("l").alias("levels")), ["ci", "tile"], "left")


#: The level where none is given, by context class (1: CG, 3: CHG, 7: CHH).
_DEFAULT_LEVEL = np.zeros(8)
_DEFAULT_LEVEL[[1, 3, 7]] = DEFAULT["CG"] / 100, DEFAULT["CHG"] / 100, DEFAULT["CHH"] / 100
#: Bases of templates that one step of the pass holds.
CELLS = 600_000


@dataclass
class Templates:
    """Fragments of one tile, padded to the longest: codes of bases, contexts, levels and origins by place."""

    ci: int
    name: str | None
    ordinal: np.ndarray
    start: np.ndarray
    span: np.ndarray
    haplotype: np.ndarray  # -1: the reference
    strand: np.ndarray
    size: np.ndarray
    base: np.ndarray
    code: np.ndarray
    level: np.ndarray
    asm: np.ndarray
    origin: np.ndarray
    events: list[list[tuple[int, int, str, int]]] | None

    @property
    def site_index(self) -> np.ndarray:
        """The number of each site in its template."""
        return np.cumsum(self.code > 0, axis=1) - 1


def templates_of(row: dict) -> Iterator[Templates]:
    """The fragments of a tile of ``placed``, in steps of about ``CELLS`` bases."""
    x, at, total = tiles.CODE[np.frombuffer(row["seq"].encode(), np.uint8)], row["from"], row["len"]
    picks = row["picks"]
    column = lambda c, default: np.array([default if p[c] is None else p[c] for p in picks], np.int64)
    ordinal, start, span, hap, strand = column("ordinal", 0), column("start", 0), column("span", 0), column("haplotype", -1), column("strand", 0)
    events = [tuple(e[c] for c in ("ref_start", "ref_end", "alt_bases", "mask")) for e in row["events"] or ()]
    for h in np.unique(hap).tolist():
        held = haplotiles.layout(x, at, total, events, h) if h >= 0 else haplotiles.plain(x, at)
        code = tiles.context_codes(held.bases)
        level, asm = _DEFAULT_LEVEL[code & 7], np.zeros(len(code), bool)
        _overlay(row["levels"] or (), h, at, len(x), held.origin, code, level, asm)
        mine = np.flatnonzero(hap == h)
        a, b = held.span(start[mine] - at, start[mine] + span[mine] - at, total - at)
        step = max(1, CELLS // max(1, int((b - a).max(initial=1))))
        for lo in range(0, len(mine), step):
            k, p, q = mine[lo : lo + step], a[lo : lo + step], b[lo : lo + step]
            grid = p[:, None] + np.arange((q - p).max())
            inside = grid < q[:, None]
            grid = np.minimum(grid, len(code) - 1)
            cells = lambda values, blank: np.where(inside, values[grid], blank)  # noqa: B023, E731
            yield Templates(
                row["ci"], row.get("name"), ordinal[k], start[k], span[k], hap[k], strand[k], q - p,
                cells(held.bases.astype(np.int64), 4), cells(code, 0), cells(level, 0.0), cells(asm, False), cells(held.origin, -1),
                [haplotiles.seen(held, int(i), int(j)) for i, j in zip(p, q, strict=True)] if held.alleles else None,
            )


def _overlay(given: list[dict], hap: int, at: int, n: int, origin: np.ndarray, code: np.ndarray, level: np.ndarray, asm: np.ndarray) -> None:
    """Given levels over the defaults, where place and context agree; a haplotype's own ones over the others."""
    for own in (False, True):
        rows = [g for g in given if 0 <= g["pos"] - at < n and (g["hap"] == hap if own else g["hap"] is None)]
        if rows:
            where = np.array([g["pos"] for g in rows], np.int64) - at
            codes, levels = np.zeros(n, np.int64), np.zeros(n)
            codes[where], levels[where] = [g["code"] for g in rows], [g["level"] for g in rows]
            k = np.flatnonzero((origin >= 0) & (code > 0))
            k = k[codes[origin[k] - at] == code[k]]
            level[k] = levels[origin[k] - at]
            asm[k] |= own


def bernoulli_states(seed: int, ci: int, ordinal: np.ndarray, site: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Independent coins at each site's level."""
    key = np.broadcast_to(rng.stage_key(seed, rng.SITE_STATE, np.array([ci])), ordinal.shape)
    return (level > 0) & ((level >= 1) | (rng.uniform(rng.block(key, rng.unsigned(ordinal), rng.unsigned(site))) < level))


def methylated_of(t: Templates, seed: int, states: Callable[..., np.ndarray] | None) -> np.ndarray:
    row, place = np.nonzero(t.code)
    out = np.zeros(t.code.shape, bool)
    if len(row):
        out[row, place] = (states or bernoulli_states)(seed, t.ci, t.ordinal[row], t.site_index[row, place], t.level[row, place])
    return out


def sites_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, ci, start, site_index, pos, code, level, methylated): the sites of every fragment, numbered in it."""
    return site_rows(placed_reads(spark, sf_dir), DEFAULTS.seed)


def placed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.contigs(spark, sf_dir)
    picked = wgbs_uniform(spark, sf_dir).select("ordinal", "ci", "start", F.lit(INSERT).cast("long").alias("span"))
    return placed(c, picked, src.levels(tiles.contexts(c)), INSERT)


def site_rows(tiled: DataFrame, seed: int) -> DataFrame:
    names = ["ordinal", "ci", "start", "site_index", "pos", "code", "level", "methylated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in haplotiles.dicts(batches):
            for t in templates_of(row):
                k, place = np.nonzero(t.code)
                meth = methylated_of(t, seed, None)
                columns = [t.ordinal[k], np.full(len(k), t.ci, np.int64), t.start[k], t.site_index[k, place].astype(np.int32), t.origin[k, place], t.code[k, place].astype(np.int32), t.level[k, place], meth[k, place]]
                yield pa.record_batch([pa.array(c) for c in columns], names)

    return tiled.mapInArrow(run, "ordinal long, ci long, start long, site_index int, pos long, code int, level double, methylated boolean")


SITES_SQL = f"""{FRAGMENTS_SQL}, {tiles.CONTEXTS_SQL}, {src.LEVELS_SQL}, overlaid AS (SELECT ci, pos, c.code, CASE WHEN level IS NULL THEN CASE WHEN c.code IN (1, 9) THEN 0.5 ELSE 0.02 END ELSE level END::DOUBLE AS level FROM contexts c LEFT JOIN levels l USING (ci, pos)),
fsites AS (SELECT ordinal, f.ci, st, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY pos) - 1 AS INTEGER) AS site_index, pos, code, level FROM fragments f JOIN overlaid o ON f.ci = o.ci AND o.pos >= st AND o.pos < st + {INSERT})"""


@query(f'WITH {SITES_SQL} SELECT ordinal, site_index, pos, code, level FROM fsites')
def fragment_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_of(spark, sf_dir).select("ordinal", "site_index", "pos", "code", "level")


@query(f"""WITH {SITES_SQL} SELECT ordinal, mate, site_index, CAST(CASE mate WHEN 0 THEN pos - st ELSE {INSERT} - 1 - (pos - st) END AS BIGINT) AS read_offset FROM fsites, (VALUES (0), (1)) AS m(mate) WHERE CASE mate WHEN 0 THEN pos - st < {READ} ELSE pos - st >= {INSERT - READ} END""")
def mate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites each mate covers, by their place in the read."""
    rows = sites_of(spark, sf_dir).withColumn("off", F.col("pos") - F.col("start"))
    first = F.when(F.col("off") < READ, F.struct(F.lit(0).alias("mate"), F.col("off").alias("read_offset")))
    last = F.when(F.col("off") >= INSERT - READ, F.struct(F.lit(1).alias("mate"), (INSERT - 1 - F.col("off")).alias("read_offset")))
    rows = rows.select("ordinal", "site_index", F.explode(F.array_compact(F.array(first, last))).alias("m"))
    return rows.select("ordinal", "m.mate", "site_index", "m.read_offset")


_STATES_SQL = f"{SITES_SQL}, {sqlgen.draws('sd', 'fsites', SEED, rng.SITE_STATE, 'ci', 'ordinal', 'site_index')}, states AS (SELECT ordinal, ci, st, site_index, pos, code, {sqlgen.coin('level')} AS methylated FROM sd)"


@query(f"WITH {_STATES_SQL} SELECT ordinal, site_index, code, methylated FROM states")
def site_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites_of(spark, sf_dir).select("ordinal", "site_index", "code", "methylated")


_MODE_SQL = f"{sqlgen.draws('md', 'fragments', SEED, rng.ORIENTATION, 'ci', 'ordinal', '0')}, modes AS (SELECT ordinal, ci, st, template, CASE WHEN {sqlgen.coin('0.5::DOUBLE')} THEN 1 ELSE 0 END AS mode FROM md)"


@query(f"WITH {FRAGMENTS_SQL}, {_MODE_SQL} SELECT ordinal, mode FROM modes")
def library_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0: C to T, 1: G to A, by a coin for each fragment of an undirected library."""
    rows = fragment_table(spark, sf_dir).withColumn("w", rng.draw(SEED, rng.ORIENTATION, F.col("ci"), F.col("ordinal"), F.lit(0)))
    return rows.select("ordinal", F.when(rng.bernoulli(F.col("w"), F.lit(0.5)), 1).otherwise(0).alias("mode"))


READ_SCHEMA = "ordinal long, ci long, name string, start long, span long, haplotype int, mode int, converted string, mate1 string, mate2 string, qual1 string, qual2 string, state string, summary1 array<int>, summary2 array<int>, whole array<int>, site_bits string, conversion_bits string, n_sites long, n_convertible long, place1 long, place2 long, stop1 long, stop2 long, cigar1 string, cigar2 string"
_NAMES = [x.split()[0] for x in READ_SCHEMA.split(", ")]
_LETTERS = np.frombuffer(b"ACGTN", np.uint8)
_STATE = np.frombuffer(sq.STATE64.encode(), np.uint8)


def _strings(values: np.ndarray, size: np.ndarray | None = None) -> pa.Array:
    """Rows of bytes as strings, each of its size."""
    n, width = values.shape
    if size is not None and not (size == width).all():
        values = values[np.arange(width) < size[:, None]]
    else:
        size = np.full(n, width)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, np.uint8)))


def _bits(flags: np.ndarray) -> str:
    """Packed bits, lowest first, in unpadded URL-safe base 64."""
    import base64

    return base64.urlsafe_b64encode(np.packbits(flags, bitorder="little").tobytes()).decode().rstrip("=")


def _summary(t: Templates, context: np.ndarray, methylated: np.ndarray, asm: np.ndarray, done: np.ndarray, target: np.ndarray, wrong: np.ndarray, false: np.ndarray, mode: np.ndarray, events: np.ndarray) -> np.ndarray:
    """The twelve counters of each row: flags; sites and methylated sites by context; conversions that
    succeeded and failed; variants; errors; errors that look like methylation.

    Flags: haplotype (0 without variants), capture strand << 2, mode << 4, allele-specific level << 7, kinds of
    variants, some conversion << 11, a counter full << 13.  ``events`` holds counts and kinds.
    """
    out = np.zeros((len(mode), 12), np.int64)
    for k in (1, 2, 3):
        out[:, 2 * k - 1] = (context == k).sum(1)
        out[:, 2 * k] = ((context == k) & methylated).sum(1)
    out[:, 7], out[:, 8] = done.sum(1), (target & ~done).sum(1)
    out[:, 9], out[:, 10], out[:, 11] = events[0], wrong, false
    full = out.max(1) > 65535
    out = np.minimum(out, 65535)
    out[:, 0] = t.haplotype + 1 | t.strand << 2 | mode << 4 | ((context > 0) & asm).any(1) << 7 | events[1] | (out[:, 7] > 0) << 11 | full << 13
    return out


def _cigars(origin: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first reference place, one past the last, operations) of rows of places in reference order.

    A row without any reference base is anchored at ``first``.
    """
    n, width = origin.shape
    start, stop = origin[:, 0].copy(), origin[:, -1] + 1
    text = [f"{width}M"] * n
    for k in np.flatnonzero((origin[:, 0] < 0) | (stop - start != width) | (origin < 0).any(1)).tolist():
        ops: list[tuple[str, int]] = []
        last = -1
        for x in origin[k].tolist():
            for op, size in ((("D", x - last - 1),) if x >= 0 and 0 <= last < x - 1 else ()) + (("I" if x < 0 else "M", 1),):
                if ops and ops[-1][0] == op:
                    ops[-1] = op, ops[-1][1] + size
                else:
                    ops.append((op, size))
            last = x if x >= 0 else last
        text[k] = "".join(f"{size}{op}" for op, size in ops)
        mapped = origin[k][origin[k] >= 0]
        start[k], stop[k] = (mapped[0], mapped[-1] + 1) if len(mapped) else (first[k], first[k] + 1)
    return start, stop, text


def _events(t: Templates, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((events, flags of their kinds), bases they cover) of the places [begin, end) of each row."""
    count, flags, cover = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.zeros((len(begin), width), bool)
    for k, held in enumerate(t.events or ()):
        for lo, hi, _, flag in held:
            if (begin[k] < lo < end[k]) if lo == hi else (max(lo, begin[k]) < min(hi, end[k])):
                count[k] += 1
                flags[k] |= flag
                cover[k, max(lo, begin[k]) - begin[k] : min(hi, end[k]) - begin[k]] = True
    return (count, flags), cover


def sequence_batch(t: Templates, p: Params, o: Options) -> pa.RecordBatch:
    """The reads of a step of fragments."""
    n, width, read = len(t.ordinal), t.base.shape[1], p.read
    ordinal = rng.unsigned(t.ordinal)
    key = lambda stage, size: np.broadcast_to(rng.stage_key(p.seed, stage, np.array([t.ci])), size)
    coin = rng.uniform(rng.block(key(rng.ORIENTATION, n), ordinal, np.zeros(n))) < 0.5
    mode = np.where(t.strand > 0, t.strand - 1, 0 if o.directional else coin).astype(np.int64)
    meth = methylated_of(t, p.seed, o.states)

    # Conversion: an unprotected C (or G) goes to T (or A).
    strand = np.where(mode[:, None] == 0, (t.code > 0) & (t.code < 8), t.code > 8)
    convertible = t.base == np.where(mode == 0, 1, 2)[:, None]
    target = convertible & ~(strand & meth)
    row, place = np.nonzero(target)
    done = np.zeros(target.shape, bool)
    done[row, place] = rng.uniform(rng.block(key(rng.CONVERSION, len(row)), ordinal[row], rng.unsigned(place))) < p.conversion
    after = np.where(done, np.where(mode == 0, 3, 0)[:, None], t.base)

    # Mates: the second reads the complement from the far end.  Errors by mate and cycle.
    cycle, line = np.arange(read), np.arange(n)[:, None]
    offsets = [np.broadcast_to(cycle, (n, read)), (t.size - 1)[:, None] - cycle]
    reads, wrongs, quals = [], [], []
    for mate in range(2 if o.paired else 1):
        at = offsets[mate]
        called = after[line, at] if mate == 0 else np.where(after[line, at] < 4, 3 - after[line, at], 4)
        if o.quality is None:
            quals.append(np.full((n, read), p.phred, np.int64))
        else:
            quals.append(samplers.markov_qualities(o.quality, mate, key(rng.QUALITY, n), ordinal, read))
        if o.confusion is not None:
            reads.append(samplers.confused(o.confusion, mate, key(rng.SEQUENCING_ERROR, n), ordinal, called, quals[mate]))
            wrongs.append(reads[mate] != called)
            continue
        if p.error == 0:
            reads.append(called)
            wrongs.append(np.zeros((n, read), bool))
            continue
        local = np.broadcast_to((mate << 32) + cycle, (n, read)).ravel()
        w = rng.block(key(rng.SEQUENCING_ERROR, n * read), np.repeat(ordinal, read), local)
        wrong = (rng.uniform(w).reshape(n, read) < p.error) & (called < 4)
        other = ((w[3] * np.uint64(3) + ((w[2] * np.uint64(3)) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64).reshape(n, read)
        reads.append(np.where(wrong, other + (other >= called), called))
        wrongs.append(wrong)

    none = lambda kind: pa.nulls(n, kind)
    row = {
        "ordinal": pa.array(t.ordinal), "ci": pa.array(np.full(n, t.ci, np.int64)), "name": pa.array([t.name] * n, pa.string()), "start": pa.array(t.start), "span": pa.array(t.span),
        "haplotype": pa.array(t.haplotype.astype(np.int32), mask=t.haplotype < 0), "mode": pa.array(mode.astype(np.int32)), "converted": _strings(_LETTERS[after], t.size),
    }
    for mate in (0, 1):
        row[f"mate{mate + 1}"] = _strings(_LETTERS[reads[mate]]) if mate < len(reads) else none(pa.string())
        row[f"qual{mate + 1}"] = _strings((quals[mate] + 33).astype(np.uint8)) if mate < len(reads) else none(pa.string())
    row |= _details(t, mode, meth, convertible, target, done, after, offsets, reads, wrongs) if o.details else {}
    kinds = dict(x.split() for x in READ_SCHEMA.split(", "))
    empty = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.record_batch([row.get(c, none(empty[kinds[c]]) if c not in row else None) for c in _NAMES], _NAMES)


def _details(t: Templates, mode, meth, convertible, target, done, after, offsets, reads, wrongs) -> dict[str, pa.Array]:
    """States, summaries, realised bits and alignments."""
    n, width = t.base.shape
    read, line = reads[0].shape[1], np.arange(n)[:, None]
    cls = t.code & 7
    context = np.select([cls == 1, cls == 3, cls == 7], [1, 2, 3], 0)
    out, states, errors, falses = {}, [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    lists = lambda x: pa.array(list(x.astype(np.int32)), pa.list_(pa.int32()))
    for mate, (at, wrong, called) in enumerate(zip(offsets, wrongs, reads, strict=False)):
        flip = mate == 1
        now = np.where(called < 4, 3 - called, 4) if flip else called  # on the template's strand
        false = wrong & np.where(mode[:, None] == 0, (after[line, at] == 3) & (now == 1), (after[line, at] == 0) & (now == 2))
        begin = t.size - read if flip else np.zeros(n, np.int64)
        counts, cover = _events(t, begin, begin + read, read)
        errors += wrong.sum(1)
        falses += false.sum(1)
        out[f"summary{mate + 1}"] = lists(_summary(t, context[line, at], meth[line, at], t.asm[line, at], done[line, at], target[line, at], wrong.sum(1), false.sum(1), mode ^ mate, counts))
        code = context[line, at] | meth[line, at] << 2 | done[line, at] << 3 | wrong.astype(np.int64) << 5
        code = (code[:, ::-1] if flip else code) | cover.astype(np.int64) << 4  # reference order
        states.append(_strings(_STATE[code]))
        origin = t.origin[line, at[:, ::-1] if flip else at]
        start, stop, text = _cigars(origin, t.start + begin)
        out |= {f"place{mate + 1}": pa.array(start), f"stop{mate + 1}": pa.array(stop), f"cigar{mate + 1}": pa.array(text)}
    counts, _ = _events(t, np.zeros(n, np.int64), t.size, width)
    sites = (t.code > 0).sum(1)
    return out | {
        "state": pc.binary_join_element_wise(*states, ","),
        "whole": lists(_summary(t, context, meth, t.asm, done, target, errors, falses, mode, counts)),
        "site_bits": pa.array([_bits(m[c > 0]) for m, c in zip(meth, t.code, strict=True)]),
        "conversion_bits": pa.array([_bits(d[c]) for d, c in zip(done, convertible, strict=True)]),
        "n_sites": pa.array(sites.astype(np.int64)), "n_convertible": pa.array(convertible.sum(1).astype(np.int64)),
    }


def sequence(tiled: DataFrame, p: Params = DEFAULTS, o: Options | None = None) -> DataFrame:
    """READ_SCHEMA for every fragment of ``placed`` tiles."""
    o = o or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in haplotiles.dicts(batches):
            for t in templates_of(row):
                yield sequence_batch(t, p, o)

    return tiled.mapInArrow(run, READ_SCHEMA)


def sequenced(spark: SparkSession, sf_dir: str, details: bool = True) -> DataFrame:
    return sequence(placed_reads(spark, sf_dir), DEFAULTS, Options(details=details))


CONVERTED_SQL = f"""{_STATES_SQL}, {_MODE_SQL}, tbases AS (SELECT ordinal, ci, st, mode, i AS off, substr(template, CAST(i + 1 AS INTEGER), 1) AS b FROM modes, unnest(range({INSERT})) AS t(i)),
{sqlgen.draws('cd', 'tbases', SEED, rng.CONVERSION, 'ci', 'ordinal', 'off')},
marked AS (SELECT c.ordinal, c.ci, c.st, mode, off, b, coalesce(s.code, 0) AS code, coalesce(methylated, false) AS methylated, (b = CASE mode WHEN 0 THEN 'C' ELSE 'G' END) AND NOT (coalesce(methylated, false) AND CASE mode WHEN 0 THEN coalesce(s.code, 0) BETWEEN 1 AND 7 ELSE coalesce(s.code, 0) > 8 END) AS target,
  {sqlgen.uniform()} < {CONVERSION_RATE} AS lucky FROM cd c LEFT JOIN states s ON c.ordinal = s.ordinal AND c.st + c.off = s.pos),
changed AS (SELECT *, target AND lucky AS done, CASE WHEN target AND lucky THEN CASE mode WHEN 0 THEN 'T' ELSE 'A' END ELSE b END AS after FROM marked)"""


@query(f"WITH {CONVERTED_SQL} SELECT ordinal, string_agg(after, '' ORDER BY off) AS converted FROM changed GROUP BY ordinal")
def conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(spark, sf_dir, details=False).select("ordinal", "converted")


READS_SQL = f"""{CONVERTED_SQL}, cycles AS (SELECT *, CASE mate WHEN 0 THEN off ELSE {INSERT} - 1 - off END AS cycle, CASE mate WHEN 0 THEN after ELSE translate(after, 'ACGTN', 'TGCAN') END AS called, (mate << 32) + CASE mate WHEN 0 THEN off ELSE {INSERT} - 1 - off END AS local
  FROM changed, (VALUES (0::BIGINT), (1::BIGINT)) AS m(mate) WHERE CASE mate WHEN 0 THEN off < {READ} ELSE off >= {INSERT - READ} END),
{sqlgen.draws('ed', 'cycles', SEED, rng.SEQUENCING_ERROR, 'ci', 'ordinal', 'local')},
called AS (SELECT * EXCLUDE (w0, w1, w2, w3), {sqlgen.uniform()} < {ERROR_RATE} AND called <> 'N' AS wrong, CASE WHEN {sqlgen.uniform()} < {ERROR_RATE} AND called <> 'N' THEN substr(replace('ACGT', called, ''), CAST(((w3 * 3 + ((w2 * 3) >> 32)) >> 32) + 1 AS INTEGER), 1) ELSE called END AS base FROM ed)"""


@query(f"WITH {READS_SQL} SELECT ordinal, mate, string_agg(base, '' ORDER BY cycle) AS seq FROM called GROUP BY ordinal, mate")
def uniform_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequenced(spark, sf_dir, details=False)
    return rows.select("ordinal", F.posexplode(F.array("mate1", "mate2")).alias("mate", "seq")).select("ordinal", F.col("mate").cast("long").alias("mate"), "seq")


def records(rows: DataFrame) -> DataFrame:
    """(mate, ordinal, record): FASTQ records of the mates there are."""
    ident = sq.read_name(F.col("name"), F.col("start"), F.col("start") + F.col("span"), F.col("ordinal"))
    mates = F.posexplode(F.array(F.struct(F.col("mate1").alias("seq"), F.col("qual1").alias("qual")), F.struct(F.col("mate2").alias("seq"), F.col("qual2").alias("qual")))).alias("mate", "m")
    out = rows.select("ordinal", ident.alias("ident"), mates).where("m.seq IS NOT NULL")
    return out.select((F.col("mate") + 1).alias("mate"), "ordinal", F.concat(F.lit("@"), F.col("ident"), F.lit("/"), F.col("mate") + 1, F.lit("\n"), F.col("m.seq"), F.lit("\n+\n"), F.col("m.qual")).alias("record"))


@query(f"""WITH {READS_SQL}, seqs AS (SELECT ordinal, any_value(ci) AS ci, any_value(st) AS st, mate, string_agg(base, '' ORDER BY cycle) AS seq FROM called GROUP BY ordinal, mate)
SELECT CAST(mate + 1 AS INTEGER) AS mate, ordinal, '@' || name || ':' || (st + 1) || '-' || (st + {INSERT}) || ':' || lower(to_hex(ordinal)) || '/' || (mate + 1) || chr(10) || seqs.seq || chr(10) || '+' || chr(10) || repeat('{chr(PHRED + 33)}', {READ}) AS record FROM seqs JOIN contigs USING (ci)""")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(sequenced(spark, sf_dir, details=False))


_STATE_SQL = "CASE code & 7 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 7 THEN 3 ELSE 0 END + CASE WHEN methylated THEN 4 ELSE 0 END + CASE WHEN done THEN 8 ELSE 0 END + CASE WHEN wrong THEN 32 ELSE 0 END"


@query(f"WITH {READS_SQL}, chars AS (SELECT ordinal, mate, off, substr('{sq.STATE64}', {_STATE_SQL} + 1, 1) AS c FROM called), texts AS (SELECT ordinal, mate, string_agg(c, '' ORDER BY off) AS t FROM chars GROUP BY ordinal, mate) SELECT ordinal, string_agg(t, ',' ORDER BY mate) AS state FROM texts GROUP BY ordinal")
def state64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One character a base, in reference order, for both mates."""
    return sequenced(spark, sf_dir).select("ordinal", "state")


NAMES = ("flags", "n_cg", "n_cg_m", "n_chg", "n_chg_m", "n_chh", "n_chh_m", "n_converted", "n_unconverted", "n_variants", "n_errors", "n_false")
_COUNTS = "CAST((MODE << 4) + CASE WHEN count(*) FILTER (done) > 0 THEN 2048 ELSE 0 END AS INTEGER) AS flags, " + ", ".join(f"CAST(count(*) FILTER (code & 7 = {c}) AS INTEGER) AS n_{n}, CAST(count(*) FILTER (code & 7 = {c} AND methylated) AS INTEGER) AS n_{n}_m" for n, c in (("cg", 1), ("chg", 3), ("chh", 7))) + ", CAST(count(*) FILTER (done) AS INTEGER) AS n_converted, CAST(count(*) FILTER (target AND NOT done) AS INTEGER) AS n_unconverted, 0::INTEGER AS n_variants"
_FALSE = "wrong AND CASE mode WHEN 0 THEN after = 'T' AND CASE mate WHEN 0 THEN base ELSE translate(base, 'ACGT', 'TGCA') END = 'C' ELSE after = 'A' AND CASE mate WHEN 0 THEN base ELSE translate(base, 'ACGT', 'TGCA') END = 'G' END"


@query(f"WITH {READS_SQL} SELECT ordinal, mate, {_COUNTS.replace('MODE', 'CASE mate WHEN 0 THEN mode ELSE 1 - mode END')}, CAST(count(*) FILTER (wrong) AS INTEGER) AS n_errors, CAST(count(*) FILTER ({_FALSE}) AS INTEGER) AS n_false FROM called GROUP BY ordinal, mate, mode")
def read_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequenced(spark, sf_dir).select("ordinal", F.posexplode(F.array("summary1", "summary2")).alias("mate", "s"))
    return rows.select("ordinal", F.col("mate").cast("long").alias("mate"), *[F.col("s")[i].alias(n) for i, n in enumerate(NAMES)])


@query(f"""WITH {READS_SQL}, mistakes AS (SELECT ordinal, CAST(count(*) FILTER (wrong) AS INTEGER) AS n_errors, CAST(count(*) FILTER ({_FALSE}) AS INTEGER) AS n_false FROM called GROUP BY ordinal),
counted AS (SELECT ordinal, {_COUNTS.replace('MODE', 'mode')} FROM changed GROUP BY ordinal, mode) SELECT * FROM counted JOIN mistakes USING (ordinal)""")
def fragment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(spark, sf_dir).select("ordinal", *[F.col("whole")[i].alias(n) for i, n in enumerate(NAMES)])


def _packed_sql(bits: str) -> str:
    """A text of 0 and 1 as bytes, lowest bit first, in unpadded URL-safe base 64."""
    byte = f"list_sum(list_transform(range(8), lambda k: CASE WHEN substr({bits}, CAST(8 * j + k + 1 AS INTEGER), 1) = '1' THEN CAST(pow(2, k) AS INTEGER) ELSE 0 END))"
    whole = f"list_aggregate(list_transform(range((length({bits}) + 7) // 8), lambda j: printf('%02x', CAST({byte} AS INTEGER))), 'string_agg', '')"
    return f"CASE WHEN length({bits}) = 0 THEN '' ELSE rtrim(translate(to_base64(unhex({whole})), '+/', '-_'), '=') END"


@query(f"""WITH {CONVERTED_SQL}, sbits AS (SELECT ordinal, count(*) AS n, string_agg(CASE WHEN methylated THEN '1' ELSE '0' END, '' ORDER BY site_index) AS b FROM states GROUP BY ordinal),
cbits AS (SELECT ordinal, count(*) AS n, string_agg(CASE WHEN done THEN '1' ELSE '0' END, '' ORDER BY off) AS b FROM changed WHERE b = CASE mode WHEN 0 THEN 'C' ELSE 'G' END GROUP BY ordinal),
every AS (SELECT f.ordinal, coalesce(s.n, 0) AS n_sites, coalesce(c.n, 0) AS n_convertible, coalesce(s.b, '') AS sb, coalesce(c.b, '') AS cb FROM fragments f LEFT JOIN sbits s ON s.ordinal = f.ordinal LEFT JOIN cbits c ON c.ordinal = f.ordinal)
SELECT ordinal, lower(to_hex(n_sites)) || '.' || lower(to_hex(n_convertible)) || '.' || {_packed_sql('sb')} || '.' || {_packed_sql('cb')} AS zx FROM every""")
def fragment_realization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in hexadecimal and packed bits of all sites and conversions of a fragment."""
    rows = sequenced(spark, sf_dir)
    return rows.select("ordinal", F.concat_ws(".", F.lower(F.hex("n_sites")), F.lower(F.hex("n_convertible")), "site_bits", "conversion_bits").alias("zx"))


@query(f"WITH {FRAGMENTS_SQL} SELECT ci, count(*) AS n_fragments, 2 * count(*) AS n_reads, CAST(sum(length(template)) AS BIGINT) AS n_bases, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM fragments GROUP BY ci")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run by contig, to reconcile outputs against."""
    return fragment_table(spark, sf_dir).groupBy("ci").agg(F.count("*").alias("n_fragments"), (F.lit(2) * F.count("*")).alias("n_reads"), F.sum(F.length("template")).alias("n_bases"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))


@query(f"""WITH {FRAGMENTS_SQL} SELECT ordinal, mate, CAST(1 + 2 + CASE mate WHEN 0 THEN 32 + 64 ELSE 16 + 128 END AS INTEGER) AS flag, CAST(CASE mate WHEN 0 THEN st + 1 ELSE st + {INSERT - READ} + 1 END AS BIGINT) AS pos, CAST(CASE mate WHEN 0 THEN {INSERT} ELSE -{INSERT} END AS INTEGER) AS tlen FROM fragments, (VALUES (0), (1)) AS m(mate)""")
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag word, 1-based place and signed template length of both mates (the first forward)."""
    rows = fragment_table(spark, sf_dir).select("ordinal", "start", F.explode(F.array(F.lit(0), F.lit(1))).alias("mate"))
    first = F.col("mate") == 0
    return rows.select("ordinal", "mate", F.when(first, 1 + 2 + 32 + 64).otherwise(1 + 2 + 16 + 128).alias("flag"), F.when(first, F.col("start") + 1).otherwise(F.col("start") + INSERT - READ + 1).alias("pos"), F.when(first, INSERT).otherwise(-INSERT).alias("tlen"))
