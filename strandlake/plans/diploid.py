"""Queries on both haplotypes: starts, restriction fragments and targets; checks and digests of a run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import philox as rng
from ..functions import seq as sq
from ..operators import relops
from ..operators.lineage import kept
from ..sources import derived as src
from . import haplotiles, sqlgen, tiles
from .basics import _PROFILE_SQL, BINS, DEFAULTS, INSERT, MAX_N, READ, SEED, Params, calibrated_weights, gc_profile, hamilton_real_sql, hamilton_sql
from .libraries import _SHIFT, CUTS, LONGEST, SHORTEST, SIGMA, VARIABLE, cuts_sql, enough, gc_placed, picks_of, seats_of, tbs_targets
from .reads import FRAGMENTS_SQL, fragment_table, fragments
from .registry import query
from .variation import _ASM, _HAPS, SEQUENCES_SQL, asm_rows, events_of, haplotype_segments, sequences

TOTAL = 4000
CORE = 16384


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both haplotypes as contigs: ci * 2 + haplotype, seq, len."""
    haps = sequences(src.contigs(spark, sf_dir), haplotype_segments(spark, sf_dir))
    return haps.select((F.col("ci") * 2 + F.col("hap")).alias("ci"), "seq", "len")


def physical_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ci, hap, pos, gc): readable places of a fixed window on either haplotype's own bases."""
    rows = tiles.valid_starts(haplotypes(spark, sf_dir), READ, INSERT, MAX_N)
    return rows.select(F.floor(F.col("ci") / 2).alias("ci"), (F.col("ci") % 2).cast("int").alias("hap"), "pos", "gc")


def _tiled(spark: SparkSession, sf_dir: str, halo: int = INSERT) -> DataFrame:
    return haplotiles.tiled(src.contigs(spark, sf_dir), events_of(spark, sf_dir), halo, CORE)


#: One number for a haplotype, to which a place is added: joins on it alone, so that no plan joins by contig only.
_KEY = "(ci * 2 + hap) * 1000000000"
#: Projections in SQL: the haplotype place of every reference boundary, and counts of N and of G and C before each place.
PROJECTED_SQL = f"""{_HAPS}, {SEQUENCES_SQL}, {src.windows_sql('hap_chars', 'haplotypes', 'ci, hap', 1)},
hap_prefix AS MATERIALIZED (SELECT {_KEY} + pos + 1 AS k, CAST(sum(CASE WHEN near = 'N' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS n, CAST(sum(CASE WHEN near IN ('C', 'G') THEN 1 ELSE 0 END) OVER w AS INTEGER) AS gc FROM hap_chars WINDOW w AS (PARTITION BY ci, hap ORDER BY pos ROWS UNBOUNDED PRECEDING) UNION ALL SELECT {_KEY}, 0, 0 FROM haplotypes),
ref_places AS (SELECT c.ci, h.hap, i AS ref FROM contigs c, (VALUES (0), (1)) AS h(hap), unnest(range(len + 1)) AS t(i)),
applied AS (SELECT ci, hap, ref_start, ref_end, event_kind, CAST(sum(delta) OVER (PARTITION BY ci, hap ORDER BY ref_start) AS BIGINT) AS upto FROM active),
bounds AS MATERIALIZED (SELECT r.ci, r.hap, (r.ci * 2 + r.hap) * 1000000000 AS base, r.ref, CASE WHEN a.event_kind = 'deletion' AND r.ref < a.ref_end THEN NULL ELSE r.ref + coalesce(upto, 0) END AS place FROM ref_places r ASOF LEFT JOIN applied a ON r.ci = a.ci AND r.hap = a.hap AND r.ref > a.ref_start)"""


_READABLE = f"""JOIN hap_prefix p ON p.k = base + place JOIN hap_prefix p2 ON p2.k = base + place + {READ} JOIN hap_prefix q ON q.k = base + stop JOIN hap_prefix q2 ON q2.k = base + stop - {READ}
  WHERE stop - place >= {READ} AND p2.n - p.n <= {MAX_N} AND q.n - q2.n <= {MAX_N}"""


def hap_starts_sql(name: str, insert: int) -> str:
    """``name`` (ci, hap, pos, place, size, gc): reference starts whose interval of ``insert`` a haplotype can be read from."""
    return f"""{name}_ends AS (SELECT ci, hap, base, ref AS pos, place, lead(place, {insert}) OVER (PARTITION BY ci, hap ORDER BY ref) AS stop FROM bounds),
{name} AS MATERIALIZED (SELECT b.ci, b.hap, pos, place, stop - place AS size, CAST(q.gc - p.gc AS BIGINT) AS gc FROM {name}_ends b {_READABLE})"""


_BIN = f"gc * {BINS - 1} // size + CASE WHEN gc * {BINS - 1} % size * 2 >= size THEN 1 ELSE 0 END"
HAP_STARTS_SQL = f"{PROJECTED_SQL}, {hap_starts_sql('hap_starts', INSERT)}, masks AS (SELECT ci, pos, CAST(bit_or(1 << hap) AS INTEGER) AS mask FROM hap_starts GROUP BY ci, pos)"


@query(f"WITH {HAP_STARTS_SQL} SELECT ci, hap, {_BIN} AS bin, count(*) AS n FROM hap_starts GROUP BY ALL")
def haplotype_gc_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable starts by contig, haplotype and GC bin of the projected template."""
    rows = haplotiles.opportunities(_tiled(spark, sf_dir), READ, INSERT, MAX_N, BINS)
    return rows.groupBy("ci", "hap", "bin").agg(F.sum("n").alias("n"))


@query(f"WITH {HAP_STARTS_SQL} SELECT ci, mask, min(pos) AS first, max(pos) AS last FROM (SELECT *, pos - row_number() OVER (PARTITION BY ci, mask ORDER BY pos) AS run FROM masks) GROUP BY ci, mask, run")
def haplotype_start_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of reference starts by the mask of haplotypes whose projected fragment is readable."""
    rows = haplotiles.mask_runs(_tiled(spark, sf_dir), READ, INSERT, MAX_N).withColumn("stop", F.col("last") + 1)
    # Only runs that a tile's end cuts are joined again.
    return relops.islands(rows, ["ci", "mask"], "first", "stop").select("ci", "mask", "first", (F.col("stop") - 1).alias("last"))


def _ranked(tile_counts: DataFrame, weight: str, draws: DataFrame) -> DataFrame:
    """``draws`` (ci, candidate, ordinal, rank) with the tile that holds their rank and what is left of it."""
    ranges = relops.running_ranges(tile_counts, ["ci"], weight, ["tile"])
    return relops.cumulative_pick(draws, ranges, ["ci"], "rank", CORE).withColumn("rest", F.col("rank") - F.col("lo"))


def draw_uniform(tiled: DataFrame, p: Params) -> DataFrame:
    """(ordinal, ci, candidate, start, mask, haplotype): even draws over the reference starts of tiles with events."""
    counts = kept(haplotiles.counts(tiled, p.read, p.insert, p.max_n))
    seats = relops.hamilton(counts.groupBy("ci").agg(F.sum("n").alias("weight")), p.total, "weight", "ci")
    draws = seats_of(seats).withColumn("w", rng.draw(p.seed, rng.FRAGMENT, F.col("ci"), F.col("candidate"), F.lit(1)))
    draws = draws.select("ci", "candidate", "ordinal", rng.bounded(F.col("w"), F.col("weight")).alias("rank"))
    rows = haplotiles.at_ranks(tiled, _ranked(counts, "n", draws), p.read, p.insert, p.max_n, False, BINS)
    return chosen(rows, p.seed).select("ordinal", "ci", "candidate", "start", "mask", "haplotype")


def chosen(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (ordinal, ci, mask, ...) with ``haplotype``: a coin where both have the fragment."""
    rows = rows.withColumn("coin", rng.draw(seed, rng.HAPLOTYPE, F.col("ci"), F.col("ordinal"), F.lit(0)))
    hap = F.when(F.col("mask") == 1, 0).when(F.col("mask") == 2, 1).otherwise(F.when(rng.bernoulli(F.col("coin"), F.lit(0.5)), 1).otherwise(0))
    return rows.withColumn("haplotype", hap).drop("coin")


def _uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_uniform(_tiled(spark, sf_dir), replace(DEFAULTS, total=TOTAL))


_UNIFORM_SQL = f"""{HAP_STARTS_SQL}, weights AS (SELECT ci, count(*) AS weight FROM masks GROUP BY ci), {hamilton_sql('weights', TOTAL, 'weight', 'ci')},
ask AS (SELECT ci, weight, i AS candidate, CAST(before + i AS BIGINT) AS ordinal FROM (SELECT ci, weight, seats, sum(seats) OVER (ORDER BY ci) - seats AS before FROM hamilton), unnest(range(seats)) AS t(i)), {sqlgen.draws('d', 'ask', SEED, rng.FRAGMENT, 'ci', 'candidate', '1')},
ranks AS (SELECT ci, candidate, ordinal, {sqlgen.bounded('weight')} AS rank FROM d), numbered AS (SELECT ci, pos, mask, row_number() OVER (PARTITION BY ci ORDER BY pos) - 1 AS rank FROM masks),
drawn AS (SELECT ci, candidate, ordinal, pos, mask FROM ranks JOIN numbered USING (ci, rank)), {sqlgen.draws('c', 'drawn', SEED, rng.HAPLOTYPE, 'ci', 'ordinal', '0')},
uniform AS (SELECT ordinal, ci, candidate, pos AS "start", mask, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE CASE WHEN {sqlgen.coin('0.5::DOUBLE')} THEN 1 ELSE 0 END END AS haplotype FROM c)"""


@query(f'WITH {_UNIFORM_SQL} SELECT ordinal, ci, candidate, "start", mask, haplotype FROM uniform')
def wgbs_haplotype_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even draws over reference starts that at least one haplotype has; a coin decides where both do."""
    return _uniform(spark, sf_dir)


@query(f"""WITH {_UNIFORM_SQL}, cut AS (SELECT u.ordinal, u.ci, haplotype, "start", place, size, substr(seq, CAST(place + 1 AS INTEGER), CAST(size AS INTEGER)) AS template FROM uniform u JOIN hap_starts s ON u.ci = s.ci AND u.haplotype = s.hap AND u."start" = s.pos JOIN haplotypes h ON u.ci = h.ci AND u.haplotype = h.hap),
alleles AS (SELECT ci, hap, ref_start, alt_bases, CAST(ref_start + shift AS BIGINT) AS lo, CAST(ref_start + shift + length(alt_bases) AS BIGINT) AS hi FROM active),
held AS (SELECT ordinal, string_agg(greatest(lo - place, 0) || ':' || least(hi - place, size) || ':' || alt_bases, ',' ORDER BY lo, ref_start) AS events FROM cut c JOIN alleles g ON g.ci = c.ci AND g.hap = c.haplotype AND CASE WHEN lo = hi THEN lo > place AND lo < place + size ELSE lo < place + size AND hi > place END GROUP BY ordinal)
SELECT ordinal, ci, haplotype, "start", template, coalesce(events, '') AS events FROM cut LEFT JOIN held USING (ordinal)""")
def haplotype_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of reference intervals on their haplotype, with the places of the alleles they hold."""
    picked = _uniform(spark, sf_dir).select("ordinal", "ci", "start", F.lit(INSERT).cast("long").alias("span"), "haplotype")
    return haplotiles.templates(_tiled(spark, sf_dir), picked, READ, MAX_N, CORE).select("ordinal", "ci", "haplotype", "start", "template", "events")


def _gc_rounds_sql(name: str, source: str, first: int, last: int) -> str:
    return f"""{name}_tries AS (SELECT a.*, attempt, 1 + 2 * attempt AS l1, 2 + 2 * attempt AS l2 FROM {source} a, unnest(range({first}, {last})) AS t(attempt)),
{sqlgen.draws(name + '_d', name + '_tries', SEED, rng.FRAGMENT, 'ci', 'candidate', 'l1')}, {name}_one AS (SELECT * EXCLUDE (w0, w1, w2, w3), {sqlgen.bounded('weight')} AS rank FROM {name}_d), {sqlgen.draws(name + '_e', name + '_one', SEED, rng.FRAGMENT, 'ci', 'candidate', 'l2')},
{name} AS (SELECT ci, candidate, min(attempt) AS attempt, arg_min(pos, attempt) AS "start", arg_min(hap, attempt) AS haplotype FROM (SELECT e.*, {sqlgen.uniform()} AS u FROM {name}_e e) x JOIN numbered USING (ci, rank) JOIN accepting USING (hap, bin) WHERE acceptance > 0 AND u < acceptance GROUP BY ci, candidate)"""


_GC_SQL = f"""{HAP_STARTS_SQL}, {_PROFILE_SQL}, chances AS (SELECT ci, hap, {_BIN} AS bin, count(*) AS n FROM hap_starts GROUP BY ALL), ratios AS (SELECT hap, bin, p * 0.5 / sum(n) AS ratio FROM chances JOIN profile USING (bin) GROUP BY hap, bin, p),
accepting AS (SELECT hap, bin, ratio / (SELECT max(ratio) FROM ratios) AS acceptance FROM ratios), masses AS (SELECT ci, list_sum(list(n * acceptance ORDER BY hap, bin)) AS mass FROM chances JOIN accepting USING (hap, bin) GROUP BY ci), {hamilton_real_sql('masses', TOTAL, 'mass', 'ci')},
weights AS (SELECT ci, count(*) AS weight FROM hap_starts GROUP BY ci), ask AS (SELECT ci, weight, i AS candidate FROM hamilton JOIN weights USING (ci), unnest(range(seats)) AS t(i)), numbered AS (SELECT ci, pos, hap, {_BIN} AS bin, row_number() OVER (PARTITION BY ci ORDER BY pos, hap) - 1 AS rank FROM hap_starts),
{_gc_rounds_sql('one', 'ask', 0, 16)}, left1 AS (SELECT * FROM ask w WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.ci = w.ci AND o.candidate = w.candidate)),
{_gc_rounds_sql('two', 'left1', 16, 400)}, left2 AS (SELECT * FROM left1 w WHERE NOT EXISTS (SELECT 1 FROM two o WHERE o.ci = w.ci AND o.candidate = w.candidate)), {_gc_rounds_sql('three', 'left2', 400, 20000)}"""


@query(f'WITH {_GC_SQL} SELECT ci, candidate, attempt, "start", haplotype FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)')
def wgbs_haplotype_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GC target over physical (start, haplotype) pairs; half of its mass is for either haplotype."""
    return draw_gc(_tiled(spark, sf_dir), gc_profile(spark), BINS, replace(DEFAULTS, total=TOTAL)).select("ci", "candidate", "attempt", "start", "haplotype")


def draw_gc(tiled: DataFrame, profile: DataFrame, bins: int, p: Params) -> DataFrame:
    """(ci, candidate, ordinal, attempt, start, haplotype) under a GC ``profile`` (bin, p)."""
    o = kept(haplotiles.opportunities(tiled, p.read, p.insert, p.max_n, bins))
    chances = o.groupBy("ci", "hap", "bin").agg(F.sum("n").alias("n"))
    ratio = chances.groupBy("hap", "bin").agg(F.sum("n").alias("n")).join(profile, "bin").select("hap", "bin", (F.col("p") * 0.5 / F.col("n")).alias("ratio"))
    accept = kept(ratio.select("hap", "bin", (F.col("ratio") / F.max("ratio").over(Window.partitionBy(F.lit(0)))).alias("acceptance")))  # two rows a bin
    seats = relops.hamilton_real(calibrated_weights(chances, accept, ["hap", "bin"]), p.total, "mass", "ci").select("ci", "seats")
    counts = kept(o.groupBy("ci", "tile").agg(F.sum("n").alias("pairs")))
    want = kept(seats_of(seats.join(counts.groupBy("ci").agg(F.sum("pairs").alias("weight")), "ci")))

    def find(tries: DataFrame) -> DataFrame:
        ranked = _ranked(counts, "pairs", tries.withColumnRenamed("attempt", "ordinal"))
        found = haplotiles.at_ranks(tiled, ranked, p.read, p.insert, p.max_n, True, bins).select("ci", "candidate", F.col("ordinal").alias("attempt"), "start", (F.col("mask") - 1).alias("hap"), F.when(F.col("mask") == 1, F.col("bin0")).otherwise(F.col("bin1")).alias("bin"))
        found = found.join(F.broadcast(accept), ["hap", "bin"], "left").select("ci", "candidate", "attempt", "start", F.col("hap").alias("haplotype"), F.coalesce("acceptance", F.lit(0.0)).alias("acceptance"))
        return tries.join(found, ["ci", "candidate", "attempt"])

    return gc_placed(want.drop("ordinal"), find, p.seed).join(want.select("ci", "candidate", "ordinal"), ["ci", "candidate"])


def _variable_rounds(name: str, source: str, lo: int, hi: int) -> str:
    low, mean, high, sd = VARIABLE
    size = f"CAST(least({high}, greatest({low}, {mean} + {_SHIFT.replace(str(SIGMA), str(sd))})) AS BIGINT)"
    good = f"""SELECT ci, candidate, any_value(seats) AS seats, any_value(span) AS span, any_value("start") AS "start", CAST(bit_or(1 << hap) AS INTEGER) AS mask FROM {name}_met {_READABLE} GROUP BY ci, candidate"""
    return f"""{name}_ask AS (SELECT ci, seats, len, candidate FROM {source} JOIN contigs USING (ci), unnest(range({lo} * seats, {hi} * seats)) AS t(candidate)), {sqlgen.draws(name + '_n', name + '_ask', SEED, rng.FRAGMENT, 'ci', 'candidate', '0')},
{name}_sized AS (SELECT * FROM (SELECT ci, seats, len, candidate, {size} AS span FROM {name}_n) WHERE len >= span), {sqlgen.draws(name + '_p', name + '_sized', SEED, rng.FRAGMENT, 'ci', 'candidate', '1')}, {name}_placed AS (SELECT ci, seats, candidate, span, {sqlgen.bounded('len - span + 1')} AS "start" FROM {name}_p),
{name}_begun AS MATERIALIZED (SELECT c.*, hap, base, place FROM {name}_placed c JOIN bounds b ON b.ci = c.ci AND b.ref = c."start"), {name}_met AS MATERIALIZED (SELECT c.*, e.place AS stop FROM {name}_begun c JOIN bounds e ON e.base = c.base AND e.ref = c."start" + c.span), {name} AS ({good})"""


_VARIABLE_SQL = f"""{PROJECTED_SQL}, {hap_starts_sql('wide', VARIABLE[2])}, weights AS (SELECT ci, count(DISTINCT pos) AS weight FROM wide GROUP BY ci), {hamilton_sql('weights', TOTAL, 'weight', 'ci')}, seated AS (SELECT ci, seats FROM hamilton WHERE seats > 0),
{_variable_rounds('one', 'seated', 0, 8)}, short1 AS (SELECT s.ci, any_value(s.seats) AS seats FROM seated s LEFT JOIN one o USING (ci) GROUP BY s.ci HAVING count(o.ci) < any_value(s.seats)), {_variable_rounds('two', 'short1', 8, 2000)},
taken AS (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY candidate) - 1 AS accept_rank FROM (SELECT * FROM one UNION ALL SELECT * FROM two))"""


@query(f'WITH {_VARIABLE_SQL} SELECT ci, candidate, accept_rank, candidate - accept_rank AS skipped, "start", span, mask FROM taken WHERE accept_rank < seats')
def wgbs_haplotype_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable reference spans on haplotypes: a candidate counts if either haplotype's template is readable."""
    rows = draw_variable(src.contigs(spark, sf_dir), _tiled(spark, sf_dir, VARIABLE[2]), replace(DEFAULTS, total=TOTAL), VARIABLE)
    return rows.select("ci", "candidate", "accept_rank", "skipped", "start", "span", "mask")


def draw_variable(contigs: DataFrame, wide: DataFrame, p: Params, sizes: tuple) -> DataFrame:
    """(ci, candidate, accept_rank, skipped, start, span, mask, seats); ``wide`` are tiles with a halo of the longest span."""
    seats = relops.hamilton(haplotiles.counts(wide, p.read, sizes[2], p.max_n).groupBy("ci").agg(F.sum("n").alias("weight")), p.total, "weight", "ci")

    def judged(short: DataFrame, lo: int, hi: int) -> DataFrame:
        ask = short.select("ci", "seats", F.explode(F.sequence(lo * F.col("seats"), hi * F.col("seats") - 1)).alias("candidate")).join(contigs.select("ci", "len"), "ci")
        ask = ask.withColumn("span", rng.clamped_normal(p.seed, rng.FRAGMENT, F.col("ci"), F.col("candidate"), F.lit(0), *sizes)).where(F.col("len") >= F.col("span"))
        ask = ask.withColumn("start", rng.pick(p.seed, rng.FRAGMENT, F.col("ci"), F.col("candidate"), F.lit(1), F.col("len") - F.col("span") + 1))
        asked = ask.select(F.col("candidate").alias("ordinal"), "ci", "start", "span", F.lit(None).cast("int").alias("haplotype"))
        good = haplotiles.templates(wide, asked, p.read, p.max_n, CORE).where("ok").groupBy("ci", F.col("ordinal").alias("candidate"), "start", "span").agg(F.bit_or(F.expr("shiftleft(1, haplotype)")).alias("mask"))
        return good.join(short.select("ci", "seats"), "ci").select("ci", "seats", "candidate", "start", "span", "mask")

    return enough(seats, judged, 3)


_HAP_CUTS = "hap_contigs AS (SELECT ci * 2 + hap AS ci, seq FROM haplotypes), " + cuts_sql("both_cuts", "hap_contigs") + ", hap_cuts AS (SELECT ci // 2 AS ci, CAST(ci % 2 AS INTEGER) AS hap, pos, sites FROM both_cuts)"


@query(f"WITH {_HAPS}, {SEQUENCES_SQL}, {_HAP_CUTS} SELECT ci, hap, pos, sites FROM hap_cuts")
def rrbs_haplotype_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts on either haplotype's own bases."""
    rows = tiles.cut_places(haplotypes(spark, sf_dir), CUTS)
    return rows.select(F.floor(F.col("ci") / 2).alias("ci"), (F.col("ci") % 2).cast("int").alias("hap"), "pos", "sites")


_DIPLOID_RRBS = f"""{_HAPS}, {SEQUENCES_SQL}, {_HAP_CUTS}, met AS (SELECT c.*, s.ref_begin + least(c.pos - s.hap_begin, s.ref_end - s.ref_begin) AS ref, s.bases IS NOT NULL AND s.ref_begin = s.ref_end AND c.pos > s.hap_begin AND c.pos < s.hap_end AS inside FROM hap_cuts c ASOF JOIN segments s ON c.ci = s.ci AND c.hap = s.hap AND c.pos >= s.hap_begin),
ranked AS (SELECT *, sum(sites) OVER (PARTITION BY ci, hap ORDER BY pos) AS upto FROM met WHERE NOT inside),
pairs AS (SELECT a.ci, a.hap, a.pos AS lft, b.pos AS rgt, a.ref AS rs, b.ref AS re, CAST(b.upto - a.upto + a.sites AS BIGINT) AS sites FROM ranked a JOIN ranked b ON a.ci = b.ci AND a.hap = b.hap AND b.pos - a.pos BETWEEN {SHORTEST} AND {LONGEST}),
cut AS (SELECT p.*, substr(seq, CAST(lft + 1 AS INTEGER), CAST(rgt - lft AS INTEGER)) AS t FROM pairs p JOIN haplotypes USING (ci, hap)),
good AS (SELECT *, CAST(rgt - lft - length(translate(t, 'CG', '')) AS BIGINT) AS gc FROM cut WHERE {READ} - length(replace(substr(t, 1, {READ}), 'N', '')) <= {MAX_N} AND {READ} - length(replace(right(t, {READ}), 'N', '')) <= {MAX_N})"""


@query(f'WITH {_DIPLOID_RRBS} SELECT ci, rs AS "start", re AS "end", rgt - lft AS template_length, gc, sites, CAST(bit_or(1 << hap) AS INTEGER) AS mask FROM good GROUP BY ALL')
def rrbs_diploid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction fragments of both haplotypes by reference envelope, with the mask of those that have it.

    Cuts inside an insertion have no reference place and are dropped; a haplotype's end can be a cut.
    """
    return haplotiles.restriction(_tiled(spark, sf_dir, 2 * LONGEST + 64), CUTS, SHORTEST, LONGEST, READ, MAX_N)


def _with_targets(tiled: DataFrame, rows: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Tiles with ``targets``, the list of ``rows`` (ci, centre, ...) whose centre lies on them."""
    lists = rows.groupBy("ci", F.floor(F.col("centre") / CORE).alias("tile")).agg(F.collect_list(F.struct(*columns)).alias("targets"))
    return tiled.join(lists, ["ci", "tile"], how)


#: Windows on haplotypes in SQL: reference boundaries of a place, and places that end an insertion.
_WINDOWS_SQL = f"""{PROJECTED_SQL}, {src.TARGETS_SQL}, exact AS MATERIALIZED (SELECT base + place AS k, min(ref) AS lo, max(ref) AS hi FROM bounds WHERE place IS NOT NULL GROUP BY k),
added AS MATERIALIZED (SELECT {_KEY} + ref_start + shift + length(alt_bases) AS k, ref_start AS r FROM active WHERE event_kind = 'insertion'),
centred AS (SELECT t.ci, b.hap, base, t.st, t.en, t.strand, t.score, b.place AS middle FROM targets t JOIN bounds b ON b.ci = t.ci AND b.ref = t.st + (t.en - t.st) // 2 WHERE place IS NOT NULL)"""


def _windows_sql(name: str, source: str, columns: str) -> str:
    """``name``: rows of ``source`` (base, place, ...) whose window from ``place`` on can be drawn, with its reference interval."""
    return f"""{name}_met AS MATERIALIZED (SELECT s.*, p.n AS n0, coalesce(x.hi, a.r) AS left_, x.k IS NULL AND a.k IS NULL AS bad0 FROM {source} s JOIN hap_prefix p ON p.k = base + place LEFT JOIN exact x ON x.k = base + place LEFT JOIN added a ON a.k = base + place WHERE place >= 0),
{name}_read AS MATERIALIZED (SELECT s.* FROM {name}_met s JOIN hap_prefix p ON p.k = base + place + {READ} JOIN hap_prefix q ON q.k = base + place + {INSERT - READ} JOIN hap_prefix r ON r.k = base + place + {INSERT} WHERE p.n - n0 <= {MAX_N} AND r.n - q.n <= {MAX_N} AND NOT bad0),
{name} AS MATERIALIZED (SELECT {columns}, CAST(left_ AS BIGINT) AS "start", CAST(coalesce(x.lo, a.r) AS BIGINT) AS "end" FROM {name}_read s LEFT JOIN exact x ON x.k = base + place + {INSERT} LEFT JOIN added a ON a.k = base + place + {INSERT} WHERE coalesce(x.lo, a.r) IS NOT NULL AND left_ <= coalesce(x.lo, a.r))"""


@query(f"""WITH {_WINDOWS_SQL}, asked AS (SELECT *, middle - {INSERT // 2} AS place FROM centred), {_windows_sql('fitting', 'asked', 's.ci, s.hap, st, en, strand, score')}
SELECT ci, st, en, strand, score, CAST(bit_or(1 << hap) AS INTEGER) AS mask FROM fitting GROUP BY ci, st, en, strand, score""")
def tbs_diploid_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose centred fragment can be drawn on a haplotype, with the mask of such haplotypes: its reads have few
    enough N and its ends are not inside an insertion."""
    rows = _diploid_targets(spark, sf_dir)
    tiled = _with_targets(_tiled(spark, sf_dir, 2 * INSERT + 64), rows, ["target", "centre"], "inner")
    masks = haplotiles.target_masks(tiled, READ, INSERT, MAX_N).where("fits > 0").select("ci", "target", F.col("fits").alias("mask"))
    return rows.join(masks, ["ci", "target"]).select("ci", "st", "en", "strand", "score", "mask")


def _diploid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = F.col("st") + F.floor((F.col("en") - F.col("st")) / 2)
    return tbs_targets(spark, sf_dir).withColumnRenamed("ordinal", "target").withColumn("centre", centre)


_TRIES = f"{_SHIFT}"


def _attempts_sql(name: str, source: str, first: int, last: int) -> str:
    return f"""{name}_tries AS (SELECT s.*, attempt, 2 + attempt AS local FROM {source} s, unnest(range({first}, {last})) AS t(attempt)), {sqlgen.draws(name + '_d', name + '_tries', SEED, rng.FRAGMENT, 'ci', 'ordinal', 'local')},
{name}_asked AS (SELECT ci, ordinal, attempt, base, middle + {_TRIES} - {INSERT // 2} AS place FROM {name}_d), {_windows_sql(name + '_all', name + '_asked', 's.ci, s.ordinal, s.attempt')},
{name} AS (SELECT ci, ordinal, min(attempt) AS attempt, arg_min("start", attempt) AS "start", arg_min("end", attempt) AS "end" FROM {name}_all GROUP BY ci, ordinal)"""


_DIPLOID_TBS = f"""{_WINDOWS_SQL}, every AS (SELECT {_KEY} AS base, unnest(range(length(seq) - {INSERT} + 1)) AS place, ci, hap FROM haplotypes WHERE length(seq) >= {INSERT}), possible AS (SELECT DISTINCT e.ci, e.hap FROM every e JOIN hap_prefix p ON p.k = base + place JOIN hap_prefix p2 ON p2.k = base + place + {READ} JOIN hap_prefix q ON q.k = base + place + {INSERT - READ} JOIN hap_prefix q2 ON q2.k = base + place + {INSERT} WHERE p2.n - p.n <= {MAX_N} AND q2.n - q.n <= {MAX_N}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY st, en, CASE strand WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END) - 1 AS target FROM targets),
choices AS (SELECT n.ci, target, n.score, CAST(bit_or(1 << c.hap) AS INTEGER) AS mask FROM numbered n JOIN centred c ON c.ci = n.ci AND c.st = n.st AND c.en = n.en AND c.strand = n.strand JOIN possible p ON p.ci = c.ci AND p.hap = c.hap GROUP BY n.ci, target, n.score),
totals AS (SELECT ci, CAST(sum(score) AS BIGINT) AS total FROM choices GROUP BY ci HAVING sum(score) > 0), ask AS (SELECT ci, total, ordinal, 8 * (row_number() OVER (ORDER BY ci, ordinal) - 1 - ordinal) // 8 + ordinal AS fragment FROM totals, unnest(range(8)) AS t(ordinal)), {sqlgen.draws('d', 'ask', SEED, rng.FRAGMENT, 'ci', 'ordinal', '1')}, picks AS (SELECT ci, ordinal, fragment, {sqlgen.bounded('total')} AS pick FROM d),
runs AS (SELECT *, sum(score) OVER (PARTITION BY ci ORDER BY target) AS upto FROM choices), chosen AS (SELECT p.ci, p.ordinal, fragment, target, mask FROM picks p JOIN runs r ON r.ci = p.ci AND pick < upto AND pick >= upto - score), {sqlgen.draws('h', 'chosen', SEED, rng.HAPLOTYPE, 'ci', 'fragment', '0')},
sided AS (SELECT ci, ordinal, target, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE CASE WHEN {sqlgen.coin('0.5::DOUBLE')} THEN 1 ELSE 0 END END AS haplotype FROM h),
want AS (SELECT s.ci, s.ordinal, s.target, s.haplotype, c.base, c.middle FROM sided s JOIN numbered n ON n.ci = s.ci AND n.target = s.target JOIN centred c ON c.ci = n.ci AND c.st = n.st AND c.en = n.en AND c.strand = n.strand AND c.hap = s.haplotype),
{_attempts_sql('one', 'want', 0, 16)}, left1 AS (SELECT * FROM want w WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.ci = w.ci AND o.ordinal = w.ordinal)), {_attempts_sql('two', 'left1', 16, 400)}, left2 AS (SELECT * FROM left1 w WHERE NOT EXISTS (SELECT 1 FROM two o WHERE o.ci = w.ci AND o.ordinal = w.ordinal)),
{_attempts_sql('three', 'left2', 400, 4000)}, placed AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)"""


@query(f'WITH {_DIPLOID_TBS} SELECT w.ci, w.ordinal AS draw, target, haplotype, attempt, "start", "end" FROM want w LEFT JOIN placed p ON p.ci = w.ci AND p.ordinal = w.ordinal')
def tbs_diploid_displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displaced target fragments on haplotypes: a target by weight, a haplotype by its mask, then attempts around the
    projected centre until a window can be drawn (4,000 here; nulls beyond)."""
    rows = _diploid_targets(spark, sf_dir)
    tiled = _tiled(spark, sf_dir, 2 * INSERT + int(2 * haplotiles.FURTHEST * SIGMA) + 64)
    masks = kept(haplotiles.target_masks(_with_targets(tiled, rows, ["target", "centre"], "left"), READ, INSERT, MAX_N))
    possible = masks.where("target IS NULL").groupBy("ci").agg(F.bit_or("any_start").alias("possible"))
    choices = masks.where("target IS NOT NULL").join(possible, "ci").select("ci", "target", F.col("centred").bitwiseAND(F.col("possible")).alias("mask")).where("mask > 0")
    choices = kept(choices.join(rows.select("ci", "target", "centre", "score"), ["ci", "target"]))
    totals = choices.groupBy("ci").agg(F.sum("score").alias("total")).where("total > 0")
    before = relops.before_each(totals.withColumn("seats", F.lit(8)), "seats", "ci").select("ci", "before")
    ranges = relops.running_ranges(choices, ["ci"], "score", ["target"], F.floor(F.col("target") / 4096))
    picked = relops.cumulative_pick(picks_of(totals.select("ci", "total", F.lit(8).alias("seats")), SEED), ranges, ["ci"], "pick", 64)
    named = chosen(picked.join(before, "ci").select("ci", F.col("ordinal").alias("draw"), (F.col("before") + F.col("ordinal")).alias("ordinal"), "target", "centre", "mask"), SEED)
    named = kept(named.select("ci", F.col("draw").alias("ordinal"), "target", "centre", "haplotype"))
    moved = haplotiles.displaced(_with_targets(tiled, named, ["ordinal", "centre", "haplotype"], "inner"), READ, INSERT, MAX_N, SEED, SIGMA, 4000)
    return named.join(moved, ["ci", "ordinal"]).select("ci", F.col("ordinal").alias("draw"), "target", "haplotype", "attempt", "start", "end")


# Checks and digests --------------------------------------------------------------------------------


@query(f"WITH {_ASM}, wanted AS (SELECT ci, pos, code FROM asm), known AS (SELECT ci, pos, code FROM contexts) SELECT count(*) AS n_rows, count(*) FILTER (k.pos IS NULL) AS n_without_site, count(*) FILTER (k.code <> w.code) AS n_other_context FROM wanted w LEFT JOIN known k USING (ci, pos)")
def level_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows against the reference: rows without a site, rows of another context."""
    known = tiles.contexts(src.contigs(spark, sf_dir)).select("ci", "pos", F.col("code").alias("own"))
    rows = asm_rows(spark, sf_dir).select("ci", "pos", "code").join(known, ["ci", "pos"], "left")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("own").isNull()).alias("n_without_site"), F.count_if(F.col("own") != F.col("code")).alias("n_other_context"))


@query(f"WITH {src.CONTIGS_SQL}, {src.VARIANTS_SQL} SELECT v.ci, count(*) AS n_variants, count(*) FILTER (substr(seq, CAST(pos + 1 AS INTEGER), length(ref)) = ref) AS n_matching FROM variants v JOIN contigs c USING (ci) GROUP BY v.ci")
def variant_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference alleles against the contig's bases; a variant meets only the tile it lies in."""
    core = 4096
    tiled = tiles.tiles(src.contigs(spark, sf_dir), 16, core).select("ci", (F.col("core_start") / core).cast("long").alias("tile"), "from", F.col("seq").alias("around"))
    rows = src.variants(spark, sf_dir).withColumn("tile", F.floor(F.col("pos") / core)).join(tiled, ["ci", "tile"])
    at = F.col("pos") - F.col("from")
    return rows.groupBy("ci").agg(F.count("*").alias("n_variants"), F.count_if(sq.piece(F.col("around"), at, at + F.length("ref")) == F.col("ref")).alias("n_matching"))


DIGESTED = 1024


@query(f"""WITH {FRAGMENTS_SQL}, blocks AS (SELECT ci, ordinal // {DIGESTED} AS block, sha256(string_agg(sha256(ordinal || ':' || st || ':' || template), '' ORDER BY ordinal)) AS d FROM fragments GROUP BY ALL)
SELECT ci, sha256(string_agg(d, '' ORDER BY block)) AS digest FROM blocks GROUP BY ci""")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-sensitive digest of each contig's fragments: of the digests of its ranges of ``DIGESTED`` ordinals, each
    of the digests of its fragments."""
    rows = fragments(spark, sf_dir).withColumn("d", F.sha2(F.concat_ws(":", F.col("ordinal").cast("string"), F.col("start").cast("string"), "template"), 256))
    joined = lambda of, by: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, of))), lambda x: x[of]), ""), 256)
    blocks = rows.groupBy("ci", F.floor(F.col("ordinal") / DIGESTED).alias("block")).agg(joined("d", "ordinal").alias("b"))
    return blocks.groupBy("ci").agg(joined("b", "block").alias("digest"))


@query(f"WITH {FRAGMENTS_SQL} SELECT count(*) AS n, count(DISTINCT ordinal) AS n_distinct, min(ordinal) AS least, max(ordinal) AS greatest, max(ordinal) - min(ordinal) + 1 = count(DISTINCT ordinal) AS consecutive FROM fragments")
def ordinal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of a run are consecutive, without gaps or repeats."""
    rows = fragment_table(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("n_distinct"), F.min("ordinal").alias("least"), F.max("ordinal").alias("greatest"))
    return rows.withColumn("consecutive", F.col("greatest") - F.col("least") + 1 == F.col("n_distinct"))


@query("SELECT l_returnflag AS run, count(*) AS n, median(l_quantity) AS middle, min(l_quantity) AS least, max(l_quantity) AS greatest, round(median(l_quantity) / max(median(l_quantity)) OVER (), 6) AS ratio FROM lineitem GROUP BY l_returnflag")
def measurement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements by run: median, extremes, and the ratio to the largest median."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("run")).agg(F.count("*").alias("n"), F.median("l_quantity").alias("middle"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("greatest"))
    return rows.withColumn("ratio", F.round(F.col("middle") / F.max("middle").over(Window.partitionBy(F.lit(0))), 6))  # one row a run


