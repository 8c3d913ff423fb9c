"""Queries on sampled models: Beta levels, short mutations, quality chains, confusions, alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import philox as rng
from ..functions import samplers
from ..operators import relops
from ..sources import derived as src
from . import sqlgen, tiles
from .basics import CATALOG_SEED, DEFAULTS, READ, SEED
from .reads import FRAGMENTS_SQL, READS_SQL, Options, placed_reads, sequence
from .registry import query
from .variation import _DENOVO_HITS, _HAPS, INDEL_RATE, MUTATION_RATE, haplotype_segments

#: Beta shapes by context class: fixed defaults.
SHAPES = {1: (0.5, 0.5), 3: (0.01, 0.05), 7: (0.01, 0.05)}
EXTENSION = 0.15
#: Example count models of three quality scores.
MARKOV = {
    "quality_scores": [10, 20, 30],
    "mates": [
        {"initial_counts": [[1, 2, 7], [1, 1, 8], [1, 3, 6], [2, 2, 6], [1, 2, 7]], "transition_counts": [[5, 3, 2], [1, 5, 4], [1, 2, 17]]},
        {"initial_counts": [[2, 2, 6], [2, 3, 5], [1, 3, 6], [2, 2, 6], [3, 2, 5]], "transition_counts": [[6, 3, 1], [2, 5, 3], [1, 3, 16]]},
    ],
}
_ROWS = [[[90, 4, 3, 3], [4, 90, 3, 3], [3, 3, 90, 4], [3, 3, 4, 90]], [[97, 1, 1, 1], [1, 97, 1, 1], [1, 1, 97, 1], [1, 1, 1, 97]], [[997, 1, 1, 1], [1, 997, 1, 1], [1, 1, 997, 1], [1, 1, 1, 997]]]
CONFUSION = {"quality_scores": [10, 20, 30], "mates": [{"base_transition_counts": _ROWS}, {"base_transition_counts": _ROWS}]}


def beta_table(sites: DataFrame, seed: int = CATALOG_SEED) -> DataFrame:
    """(ci, pos, code, level): a Beta level for every site, by its context's shapes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ci, pos, code = (batch[c].to_numpy() for c in ("ci", "pos", "code"))
            level = np.zeros(len(pos), np.float32)
            distinct, place = np.unique(ci, return_inverse=True)
            key = rng.stage_key(seed, rng.METHYLATION_LEVEL, distinct)[place] if len(ci) else np.zeros(0, np.uint64)
            for kind, shape in SHAPES.items():
                at = np.flatnonzero((code & 7) == kind)
                if len(at):
                    level[at] = samplers.beta(key[at], pos[at].astype(np.uint64), *shape)
            yield pa.record_batch([batch["ci"], batch["pos"], batch["code"], pa.array(level)], ["ci", "pos", "code", "level"])

    return sites.mapInArrow(run, "ci long, pos long, code int, level float")


_TOP = lambda lo, hi: f"((w{hi} << 21) | (w{lo} >> 11))::DOUBLE"
_GAUSS = f"(sqrt(-2.0 * ln(({_TOP(0, 1)} + 1) * {2.0**-53!r})) * cos(2.0 * pi() * ({_TOP(2, 3)} * {2.0**-53!r})))"
_OPEN = f"(({_TOP(0, 1)} + 1) * {2.0**-53!r})"


def _gamma_sql(name: str, source: str, first: int, last: int) -> str:
    """``name`` (ci, pos, role, shape, g): the first accepted of attempts [first, last) of ``source``, before the boost."""
    return f"""{name}_tries AS (SELECT s.*, attempt, (role::UBIGINT << 62) | (2 * attempt)::UBIGINT AS l1, (role::UBIGINT << 62) | (2 * attempt + 1)::UBIGINT AS l2 FROM {source} s, unnest(range({first}, {last})) AS t(attempt)), {sqlgen.draws(name + '_n', name + '_tries', CATALOG_SEED, rng.METHYLATION_LEVEL, 'ci', 'pos', 'l1')},
{name}_x AS (SELECT ci, pos, role, shape, attempt, l2, x, pow(1 + x / sqrt(9 * (shape + 1 - 1.0::DOUBLE / 3)), 3) AS v, shape + 1 - 1.0::DOUBLE / 3 AS d FROM (SELECT *, {_GAUSS} AS x FROM {name}_n)), {sqlgen.draws(name + '_u', name + '_x', CATALOG_SEED, rng.METHYLATION_LEVEL, 'ci', 'pos', 'l2')},
{name} AS (SELECT ci, pos, role, shape, arg_min(d * v, attempt) AS g FROM {name}_u WHERE v > 0 AND ln({_OPEN}) < 0.5 * x * x + d - d * v + d * ln(greatest(v, 1e-300)) GROUP BY ci, pos, role, shape)"""


_SHAPE_ROWS = ", ".join(f"({k}, {role}, {shape!r}::DOUBLE)" for k, (x, y) in SHAPES.items() for role, shape in ((samplers.ALPHA, x), (samplers.BETA, y)))
_BETA_SQL = f"""{src.CONTIGS_SQL}, {tiles.CONTEXTS_SQL}, roles AS (SELECT ci, pos, role, shape FROM contexts JOIN (VALUES {_SHAPE_ROWS}) AS t(class, role, shape) ON class = code & 7),
{_gamma_sql('one', 'roles', 0, 2)}, left1 AS (SELECT * FROM roles r WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.ci = r.ci AND o.pos = r.pos AND o.role = r.role)), {_gamma_sql('two', 'left1', 2, 40)},
plain AS (SELECT *, (role + 1)::UBIGINT << 62 AS local FROM (SELECT * FROM one UNION ALL SELECT * FROM two)), {sqlgen.draws('b', 'plain', CATALOG_SEED, rng.METHYLATION_LEVEL, 'ci', 'pos', 'local')},
drawn AS (SELECT ci, pos, max(CASE WHEN role = {samplers.ALPHA} THEN g * pow({_OPEN}, 1 / shape) END) AS x, max(CASE WHEN role = {samplers.BETA} THEN g * pow({_OPEN}, 1 / shape) END) AS y FROM b GROUP BY ci, pos)"""


@query(f"WITH {_BETA_SQL} SELECT c.ci, c.pos, code, round((x / (x + y))::FLOAT::DOUBLE, 5) AS level FROM contexts c JOIN drawn d ON d.ci = c.ci AND d.pos = c.pos")
def beta_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Beta level for every site, to five digits."""
    return beta_table(tiles.contexts(src.contigs(spark, sf_dir))).withColumn("level", F.round(F.col("level").cast("double"), 5))


_LOCALS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 16, 17)
_U, _W = sqlgen.uniform(), sqlgen.bounded
_EVENTS_SQL = f"""{_DENOVO_HITS}, asked AS (SELECT ci, pos, l FROM hit, unnest({list(_LOCALS)}) AS t(l)), {sqlgen.draws('v', 'asked', CATALOG_SEED, rng.MUTATION, 'ci', 'pos', 'l')},
wide AS (SELECT ci, pos, {', '.join(f'max(CASE WHEN l = {k} THEN {_U} END) AS u{k}' for k in (1, 3, 4, 5, 6, 16, 17))}, max(CASE WHEN l = 2 THEN {_W('3')} END) AS s2, {', '.join(f'max(CASE WHEN l = {k} THEN {_W("4")} END) AS i{k}' for k in (8, 9, 10, 11))} FROM v GROUP BY ci, pos),
{src.windows_sql('fours', 'contigs', 'ci', 4, '----').replace('at0 + j AS pos', 'at0 + j - 4 AS pos')},
sized AS (SELECT w.*, near, length(regexp_extract(near, '^[ACGT]+')) AS m, 1 + CASE WHEN u4 < {EXTENSION} THEN 1 + CASE WHEN u5 < {EXTENSION} THEN 1 + CASE WHEN u6 < {EXTENSION} THEN 1 ELSE 0 END ELSE 0 END ELSE 0 END AS size FROM wide w JOIN fours f ON f.ci = w.ci AND f.pos = w.pos),
kinds AS (SELECT *, CASE WHEN u1 >= {INDEL_RATE} THEN 'S' WHEN u3 < 0.5 THEN 'D' ELSE 'I' END AS kind, CASE WHEN u16 < 1.0::DOUBLE / 3 THEN 3 WHEN u17 < 0.5 THEN 1 ELSE 2 END AS mask, least(size, m) AS cut FROM sized),
spans AS (SELECT *, CASE kind WHEN 'S' THEN pos + 1 WHEN 'D' THEN pos + cut ELSE pos + 2 END AS free, CASE WHEN lag(pos) OVER w IS NULL OR pos - lag(pos) OVER w > {samplers.REACH} THEN 1 ELSE 0 END AS opens FROM kinds WINDOW w AS (PARTITION BY ci ORDER BY pos)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY ci ORDER BY pos) AS island FROM spans), ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ci, island ORDER BY pos) AS k FROM grouped),
scan AS (SELECT ci, island, k, pos, free AS until, true AS taken FROM ordered WHERE k = 1 UNION ALL SELECT o.ci, o.island, o.k, o.pos, CASE WHEN o.pos >= s.until THEN o.free ELSE s.until END, o.pos >= s.until FROM scan s JOIN ordered o ON o.ci = s.ci AND o.island = s.island AND o.k = s.k + 1)"""


@query(f"""WITH RECURSIVE {src.CONTIGS_SQL}, {_EVENTS_SQL} SELECT ci, kind, CAST(CASE kind WHEN 'I' THEN pos + 1 ELSE pos END AS BIGINT) AS ref_start, CAST(CASE kind WHEN 'S' THEN pos + 1 WHEN 'D' THEN pos + cut ELSE pos + 1 END AS BIGINT) AS ref_end,
CASE kind WHEN 'S' THEN substr(near, 1, 1) WHEN 'D' THEN substr(near, 1, CAST(cut AS INTEGER)) ELSE '' END AS ref, CASE kind WHEN 'S' THEN substr('ACGT', CAST((strpos('ACGT', substr(near, 1, 1)) + s2) & 3 AS INTEGER) + 1, 1) WHEN 'D' THEN '' ELSE substr(substr('ACGT', CAST(i8 + 1 AS INTEGER), 1) || substr('ACGT', CAST(i9 + 1 AS INTEGER), 1) || substr('ACGT', CAST(i10 + 1 AS INTEGER), 1) || substr('ACGT', CAST(i11 + 1 AS INTEGER), 1), 1, CAST(size AS INTEGER)) END AS alt,
CAST(mask AS INTEGER) AS mask FROM ordered JOIN (SELECT ci, pos FROM scan WHERE taken) USING (ci, pos)""")
def denovo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of every contig after neighbours have suppressed each other."""
    return mutations(src.contigs(spark, sf_dir), MUTATION_RATE, INDEL_RATE, EXTENSION, CATALOG_SEED)


def mutations(contigs: DataFrame, rate: float, indels: float, extension: float, seed: int, homozygous: bool = False, halo: int = 4096) -> DataFrame:
    """(ci, kind, ref_start, ref_end, ref, alt, mask), map-only over tiles.

    An accepted event keeps a few places from the next ones, so a scan starts in the halo, after a gap that none
    reaches over; a halo without such a gap is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ci, a, b, at, seq in zip(*(batch[c].to_pylist() for c in ("ci", "core_start", "core_end", "from", "seq")), strict=True):
                x = tiles.CODE[np.frombuffer(seq.encode(), np.uint8)]
                key = rng.stage_key(seed, rng.MUTATION, np.array([ci]))
                pos = np.flatnonzero(x[: b - at] < 4) + at
                pos = pos[rng.uniform(rng.block(np.broadcast_to(key, pos.shape), pos, np.zeros(len(pos)))) < rate]
                found = samplers.denovo_events(int(key[0]), pos[samplers.restart(pos, at) :], x, indels, extension, homozygous, at)
                # An insertion stands after the base that mutated.
                rows = [e for e in found if a <= e[1] - (e[0] == "I") < b]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.record_batch([pa.array([ci] * len(rows), pa.int64()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["ci", "kind", "ref_start", "ref_end", "ref", "alt", "mask"])

    return tiles.tiles(contigs, halo).mapInArrow(run, "ci long, kind string, ref_start long, ref_end long, ref string, alt string, mask int")


def _cumulative_sql(name: str, rows: list[tuple[int, int, list[int]]]) -> str:
    """``name`` (mate, row, upto, total): running counts of each row of a count model."""
    values = ", ".join(f"({mate}::BIGINT, {k}::BIGINT, {np.cumsum(counts).tolist()}::BIGINT[], {sum(counts)}::BIGINT)" for mate, k, counts in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) AS t(mate, row, upto, total))"


_PICKED = "list_sum(list_transform(upto, lambda u: CASE WHEN u <= {pick} THEN 1 ELSE 0 END))::BIGINT"
_CHAIN_SQL = f"""{_cumulative_sql('opening', [(m, t, r) for m, x in enumerate(MARKOV['mates']) for t, r in enumerate(x['initial_counts'])])}, {_cumulative_sql('stepping', [(m, t, r) for m, x in enumerate(MARKOV['mates']) for t, r in enumerate(x['transition_counts'])])},
qask AS (SELECT ordinal, ci, mate, t, (mate << 32) + t AS local FROM fragments, (VALUES (0::BIGINT), (1::BIGINT)) AS m(mate), unnest(range({READ})) AS r(t)), {sqlgen.draws('qd', 'qask', SEED, rng.QUALITY, 'ci', 'ordinal', 'local')},
chain AS (SELECT q.ordinal, q.mate, t, {_PICKED.format(pick=sqlgen.bounded('total'))} AS state FROM qd q JOIN opening o ON o.mate = q.mate AND o.row = q.t WHERE t = 0
  UNION ALL SELECT c.ordinal, c.mate, q.t, {_PICKED.format(pick=sqlgen.bounded('total'))} FROM chain c JOIN qd q ON q.ordinal = c.ordinal AND q.mate = c.mate AND q.t = c.t + 1 JOIN (SELECT mate, row, 0 AS later, upto, total FROM opening UNION ALL SELECT mate, row, 1, upto, total FROM stepping) o ON o.mate = c.mate AND o.later = CASE WHEN c.t + 1 < 5 THEN 0 ELSE 1 END AND o.row = CASE WHEN c.t + 1 < 5 THEN c.t + 1 ELSE c.state END)"""
_SCORE = f"{MARKOV['quality_scores']}::BIGINT[]"


@query(f"WITH RECURSIVE {FRAGMENTS_SQL}, {_CHAIN_SQL} SELECT ordinal, CAST(mate AS INTEGER) AS mate, string_agg(chr(CAST(({_SCORE})[state + 1] + 33 AS INTEGER)), '' ORDER BY t) AS qual FROM chain GROUP BY ordinal, mate")
def markov_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality strings of both mates, drawn by the chain."""
    rows = sequence(placed_reads(spark, sf_dir), DEFAULTS, Options(quality=MARKOV, details=False))
    return rows.select("ordinal", F.posexplode(F.array("qual1", "qual2")).alias("mate", "qual"))


_CONFUSED_SQL = f"""{_cumulative_sql('mixing', [(m, 4 * q + b, r) for m, x in enumerate(CONFUSION['mates']) for q, rows in enumerate(x['base_transition_counts']) for b, r in enumerate(rows)])},
mixed AS (SELECT e.ordinal, e.mate, e.cycle, CASE WHEN called = 'N' THEN 'N' ELSE substr('ACGT', CAST({_PICKED.format(pick=sqlgen.bounded('total'))} + 1 AS INTEGER), 1) END AS base, called FROM ed e JOIN chain c ON c.ordinal = e.ordinal AND c.mate = e.mate AND c.t = e.cycle JOIN mixing x ON x.mate = e.mate AND x.row = 4 * c.state + CASE called WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'N' THEN 3 ELSE 0 END)"""


@query(f"WITH RECURSIVE {READS_SQL}, {_CHAIN_SQL}, {_CONFUSED_SQL} SELECT ordinal, CAST(mate AS INTEGER) AS mate, string_agg(base, '' ORDER BY cycle) AS seq, CAST(count(*) FILTER (base <> called) AS INTEGER) AS n_errors FROM mixed GROUP BY ordinal, mate")
def confusion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both mates after conversion and quality-dependent substitution, their qualities drawn by the chain."""
    rows = sequence(placed_reads(spark, sf_dir), DEFAULTS, Options(quality=MARKOV, confusion=CONFUSION))
    mates = F.posexplode(F.array(*[F.struct(F.col(f"mate{k}").alias("seq"), F.element_at(f"summary{k}", 11).alias("n_errors")) for k in (1, 2)])).alias("mate", "m")
    return rows.select("ordinal", mates).select("ordinal", "mate", "m.seq", "m.n_errors")


# Haplotype starts and alignments -------------------------------------------------------------------


CIGAR_SQL = f"""reads AS (SELECT DISTINCT s.ci, s.hap, t.st AS read_start FROM targets t JOIN (SELECT ci, hap, max(hap_end) AS len FROM segments GROUP BY ci, hap) s ON s.ci = t.ci WHERE t.st + {READ} <= s.len),
parts AS (SELECT r.ci, r.hap, read_start, hap_begin, CASE WHEN bases IS NOT NULL AND ref_begin = ref_end THEN 'I' ELSE 'M' END AS op, least(hap_end, read_start + {READ}) - greatest(hap_begin, read_start) AS n, ref_begin, ref_end FROM reads r JOIN segments s ON r.ci = s.ci AND r.hap = s.hap AND s.hap_begin < read_start + {READ} AND s.hap_end > read_start),
gaps AS (SELECT *, CASE WHEN lag(ref_end) OVER w IS NULL THEN 0 ELSE ref_begin - lag(ref_end) OVER w END AS skipped FROM parts WINDOW w AS (PARTITION BY ci, hap, read_start ORDER BY hap_begin)),
ops AS (SELECT ci, hap, read_start, hap_begin * 2 AS place, 'D' AS op, skipped AS n FROM gaps WHERE skipped > 0 UNION ALL SELECT ci, hap, read_start, hap_begin * 2 + 1, op, n FROM gaps),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY ci, hap, read_start ORDER BY place) AS run FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY ci, hap, read_start ORDER BY place) = op THEN 0 ELSE 1 END AS opens FROM ops)),
merged AS (SELECT ci, hap, read_start, run, any_value(op) AS op, CAST(sum(n) AS BIGINT) AS n FROM runs GROUP BY ci, hap, read_start, run)"""


@query(f"WITH {_HAPS}, {src.TARGETS_SQL}, {CIGAR_SQL} SELECT ci, hap, read_start, string_agg(n || op, '' ORDER BY run) AS cigar FROM merged GROUP BY ci, hap, read_start")
def cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of haplotype reads to the reference: matches, insertions and deletions."""
    parts = haplotype_segments(spark, sf_dir)
    ends = parts.groupBy("ci", "hap").agg(F.max("hap_end").alias("len"))
    reads = src.targets(spark, sf_dir).select("ci", F.col("st").alias("read_start")).distinct().join(ends, "ci").withColumn("read_end", F.col("read_start") + READ).where("read_end <= len")
    met = relops.overlap_join(reads.select("ci", "hap", "read_start", "read_end"), parts, ["ci", "hap"], "read_start", "read_end", "hap_begin", "hap_end", 64)
    op = F.when(F.col("bases").isNotNull() & (F.col("ref_begin") == F.col("ref_end")), "I").otherwise("M")
    size = F.least("hap_end", "read_end") - F.greatest("hap_begin", "read_start")
    lists = met.groupBy("ci", "hap", "read_start").agg(F.sort_array(F.collect_list(F.struct("hap_begin", op.alias("op"), size.alias("n"), "ref_begin", "ref_end"))).alias("p"))
    # One fold a read: the text so far, the open operation and its length, and the reference place.
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("op"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"))

    def fold(a, x):
        gap = F.coalesce(x["ref_begin"] - a["at"], F.lit(0).cast("long"))
        closed = F.when(a["n"] > 0, F.concat(a["text"], a["n"].cast("string"), a["op"])).otherwise(a["text"])
        text = F.when(gap > 0, F.concat(closed, gap.cast("string"), F.lit("D"))).when(a["op"] == x["op"], a["text"]).otherwise(closed)
        n = F.when((gap == 0) & (a["op"] == x["op"]), a["n"] + x["n"]).otherwise(x["n"])
        return F.struct(text.alias("text"), x["op"].alias("op"), n.alias("n"), x["ref_end"].alias("at"))

    return lists.select("ci", "hap", "read_start", F.aggregate("p", start, fold, lambda a: F.concat(a["text"], a["n"].cast("string"), a["op"])).alias("cigar"))


