"""Queries on variants, haplotypes and methylation levels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import philox as rng
from ..functions import seq as sq
from ..operators import relops
from ..sources import derived as src
from . import sqlgen, tiles
from .basics import CATALOG_SEED
from .registry import query

# Normalisation -------------------------------------------------------------------------------------


def _common(a: Column, b: Column) -> Column:
    """How many leading characters two short strings share."""
    at = lambda s, k: F.substr(s, k, F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), F.lit(0), lambda n, k: F.when((n == k - 1) & (at(a, k) == at(b, k)), k).otherwise(n))


def normalize(rows: DataFrame) -> DataFrame:
    """Call-file alleles to events: shared prefix and suffix off, a kind, and 0-based reference bounds."""
    rows = rows.withColumn("_p", _common(F.col("ref"), F.col("alt")))
    rows = rows.withColumn("r1", F.expr("substring(ref, _p + 1)")).withColumn("a1", F.expr("substring(alt, _p + 1)"))
    rows = rows.withColumn("_s", F.when((F.col("r1") == "") | (F.col("a1") == ""), 0).otherwise(_common(F.reverse("r1"), F.reverse("a1"))))
    rows = rows.withColumn("ref_bases", F.expr("left(r1, length(r1) - _s)")).withColumn("alt_bases", F.expr("left(a1, length(a1) - _s)"))
    rows = rows.withColumn("ref_start", F.col("pos") + F.col("_p")).withColumn("ref_end", F.col("ref_start") + F.length("ref_bases"))
    kind = F.when(F.length("ref_bases") == F.length("alt_bases"), "snv").when(F.col("ref_bases") == "", "insertion").otherwise("deletion")
    return rows.select("ci", "ref_start", "ref_end", kind.alias("event_kind"), "ref_bases", "alt_bases", "mask")


# The derived alleles are an anchor base and at most two more on one side, so the prefix is 0 or 1.
EVENTS_SQL = """events AS (SELECT ci, pos + p AS ref_start, pos + p + length(substr(ref, p + 1)) AS ref_end, CASE WHEN p = 0 THEN 'snv' WHEN length(ref) < length(alt) THEN 'insertion' ELSE 'deletion' END AS event_kind,
  substr(ref, p + 1) AS ref_bases, substr(alt, p + 1) AS alt_bases, mask FROM (SELECT *, CASE WHEN substr(ref, 1, 1) = substr(alt, 1, 1) THEN 1 ELSE 0 END AS p FROM variants))"""
_VARIANTS = f"{src.CONTIGS_SQL}, {src.VARIANTS_SQL}, {EVENTS_SQL}"


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(src.variants(spark, sf_dir))


@query(f"WITH {_VARIANTS} SELECT ci, ref_start, ref_end, event_kind, ref_bases, alt_bases, mask FROM events")
def vcf_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir)


_PHASE = f"WITH {_VARIANTS}, ask AS (SELECT *, row_number() OVER (PARTITION BY ci ORDER BY ref_start) - 1 AS event_ordinal FROM events), {sqlgen.draws('d', 'ask', CATALOG_SEED, rng.HAPLOTYPE, 'ci', 'event_ordinal', '1')}"


@query(f"{_PHASE} SELECT ci, event_ordinal, CASE WHEN mask = 3 THEN 3 WHEN event_kind = 'snv' THEN CASE WHEN {sqlgen.coin('0.5::DOUBLE')} THEN 2 ELSE 1 END ELSE mask END AS phased FROM d")
def vcf_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterozygous substitutions count as unphased: a coin per event places them."""
    rows = events_of(spark, sf_dir).withColumn("event_ordinal", F.row_number().over(Window.partitionBy("ci").orderBy("ref_start")).cast("long") - 1)
    rows = rows.withColumn("w", rng.draw(CATALOG_SEED, rng.HAPLOTYPE, F.col("ci"), F.col("event_ordinal"), F.lit(1)))
    coin = F.when(rng.bernoulli(F.col("w"), F.lit(0.5)), 2).otherwise(1)
    return rows.select("ci", "event_ordinal", F.when(F.col("mask") == 3, 3).when(F.col("event_kind") == "snv", coin).otherwise(F.col("mask")).alias("phased"))


_LOOSE = "loose AS (SELECT DISTINCT ci, h % (len - 8) AS st, h % (len - 8) + l_linenumber % 4 AS en FROM " + src._ITEMS_SQL + " WHERE len > 8)"


@query(f"""WITH {src.CONTIGS_SQL}, {_LOOSE} SELECT ci, st, en FROM (SELECT *, max(greatest(en, st)) OVER w AS reach, lag(st) OVER (PARTITION BY ci ORDER BY st, en) AS prev_st, lag(en) OVER (PARTITION BY ci ORDER BY st, en) AS prev_en FROM loose WINDOW w AS (PARTITION BY ci ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE st < reach OR (st = en AND prev_st = st AND prev_en = st)""")
def vcf_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that overlap an earlier one, or insert where another does."""
    h, n = F.col("h"), F.col("len") - 8
    rows = src._on_contig(spark, sf_dir).where("len > 8").select("ci", (h % n).alias("st"), (h % n + F.col("l_linenumber") % 4).alias("en")).distinct()
    w = Window.partitionBy("ci").orderBy("st", "en")
    rows = rows.withColumn("reach", F.max("en").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("prev_st", F.lag("st").over(w)).withColumn("prev_en", F.lag("en").over(w))
    return rows.where((F.col("st") < F.col("reach")) | ((F.col("st") == F.col("en")) & (F.col("prev_st") == F.col("st")) & (F.col("prev_en") == F.col("st")))).select("ci", "st", "en")


@query(f"WITH {src.CONTIGS_SQL}, steps AS (SELECT ci, h % len AS pos, lag(h % len) OVER (PARTITION BY ci ORDER BY l_orderkey, l_linenumber, l_partkey) AS before FROM {src._ITEMS_SQL}) SELECT ci, count(*) AS n, count(*) FILTER (pos <= before) AS backward FROM steps GROUP BY ci")
def profile_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often positions of a contig fail to increase in file order."""
    rows = src._on_contig(spark, sf_dir).withColumn("pos", F.col("h") % F.col("len"))
    before = F.lag("pos").over(Window.partitionBy("ci").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return rows.withColumn("before", before).groupBy("ci").agg(F.count("*").alias("n"), F.count_if(F.col("pos") <= F.col("before")).alias("backward"))


# Haplotypes ----------------------------------------------------------------------------------------


def segments(contigs: DataFrame, events: DataFrame) -> DataFrame:
    """(ci, hap, hap_begin, hap_end, ref_begin, ref_end, bases): reference runs (bases null) and alleles.

    Windows run over events, of which there are thousands of times fewer than bases.
    """
    active = events.withColumn("hap", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.expr("(mask & shiftleft(1, hap)) > 0"))
    w = Window.partitionBy("ci", "hap").orderBy("ref_start")
    delta = F.length("alt_bases") - (F.col("ref_end") - F.col("ref_start"))
    active = active.withColumn("shift", F.coalesce(F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    active = active.withColumn("before", F.coalesce(F.lag("ref_end").over(w), F.lit(0).cast("long")))
    alleles = active.where("alt_bases <> ''").select("ci", "hap", (F.col("ref_start") + F.col("shift")).alias("hap_begin"), F.col("ref_start").alias("ref_begin"), "ref_end", F.col("alt_bases").alias("bases"))
    alleles = alleles.select("ci", "hap", "hap_begin", (F.col("hap_begin") + F.length("bases")).alias("hap_end"), "ref_begin", "ref_end", "bases")
    runs = active.select("ci", "hap", (F.col("before") + F.col("shift")).alias("hap_begin"), F.col("before").alias("ref_begin"), F.col("ref_start").alias("ref_end"))
    tail = active.groupBy("ci", "hap").agg(F.max("ref_end").alias("ref_begin"), F.sum(delta).alias("shift"))
    both = contigs.select("ci", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("hap"))
    tail = both.join(tail, ["ci", "hap"], "left").select("ci", "hap", (F.coalesce("ref_begin", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("hap_begin"), F.coalesce("ref_begin", F.lit(0).cast("long")).alias("ref_begin"), F.col("len").alias("ref_end"))
    runs = runs.unionByName(tail).where("ref_end > ref_begin").select("ci", "hap", "hap_begin", (F.col("hap_begin") + F.col("ref_end") - F.col("ref_begin")).alias("hap_end"), "ref_begin", "ref_end", F.lit(None).cast("string").alias("bases"))
    return runs.unionByName(alleles)


SEGMENTS_SQL = """active AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY ci, hap ORDER BY ref_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, coalesce(lag(ref_end) OVER (PARTITION BY ci, hap ORDER BY ref_start), 0) AS before
  FROM (SELECT e.*, hap, length(alt_bases) - (ref_end - ref_start) AS delta FROM events e, (VALUES (0), (1)) AS h(hap) WHERE (mask >> hap) & 1 = 1)),
tails AS (SELECT c.ci, h.hap, len, coalesce(max(ref_end), 0) AS ref_begin, coalesce(sum(delta), 0) AS shift FROM contigs c CROSS JOIN (VALUES (0), (1)) AS h(hap) LEFT JOIN active a ON a.ci = c.ci AND a.hap = h.hap GROUP BY ALL),
segments AS (SELECT ci, hap, CAST(hap_begin AS BIGINT) AS hap_begin, CAST(hap_begin + ref_end - ref_begin AS BIGINT) AS hap_end, CAST(ref_begin AS BIGINT) AS ref_begin, CAST(ref_end AS BIGINT) AS ref_end, NULL::VARCHAR AS bases FROM (
    SELECT ci, hap, before + shift AS hap_begin, before AS ref_begin, ref_start AS ref_end FROM active UNION ALL SELECT ci, hap, ref_begin + shift, ref_begin, len FROM tails) WHERE ref_end > ref_begin
  UNION ALL SELECT ci, hap, CAST(ref_start + shift AS BIGINT), CAST(ref_start + shift + length(alt_bases) AS BIGINT), ref_start, ref_end, alt_bases FROM active WHERE alt_bases <> '')"""
_HAPS = f"{_VARIANTS}, {SEGMENTS_SQL}"


@query(f"WITH {_HAPS} SELECT ci, hap, hap_begin, hap_end, ref_begin, ref_end, bases FROM segments")
def haplotype_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(src.contigs(spark, sf_dir), events_of(spark, sf_dir))


def sequences(contigs: DataFrame, parts: DataFrame) -> DataFrame:
    """(ci, hap, seq, len): each haplotype's bases, its segments laid end to end."""
    cut = parts.groupBy("ci", "hap").agg(F.sort_array(F.collect_list(F.struct("hap_begin", "ref_begin", "ref_end", "bases"))).alias("parts"))
    rows = cut.join(contigs.select("ci", "seq"), "ci")
    piece = lambda p: F.coalesce(p["bases"], sq.piece(F.col("seq"), p["ref_begin"], p["ref_end"]))
    rows = rows.select("ci", "hap", F.array_join(F.transform("parts", piece), "").alias("seq"))
    return rows.withColumn("len", F.length("seq").cast("long"))


SEQUENCES_SQL = "haplotypes AS (SELECT ci, hap, string_agg(coalesce(bases, substr(seq, CAST(ref_begin + 1 AS INTEGER), CAST(ref_end - ref_begin AS INTEGER))), '' ORDER BY hap_begin, ref_begin) AS seq FROM segments JOIN contigs USING (ci) GROUP BY ci, hap)"


@query(f"WITH {_HAPS}, {SEQUENCES_SQL} SELECT ci, hap, CAST(length(seq) AS BIGINT) AS len, sha256(seq) AS sha256 FROM haplotypes")
def haplotype_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(src.contigs(spark, sf_dir), haplotype_segments(spark, sf_dir)).select("ci", "hap", "len", F.sha2("seq", 256).alias("sha256"))


def boundaries(points: DataFrame, contigs: DataFrame, events: DataFrame, point: str, out: str) -> DataFrame:
    """``out``: the haplotype place of a reference boundary; null strictly inside a deletion.

    Between two event starts the shift is constant, so a boundary meets one zone: a binned range join.
    """
    active = events.withColumn("hap", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.expr("(mask & shiftleft(1, hap)) > 0"))
    w = Window.partitionBy("ci", "hap").orderBy("ref_start")
    delta = F.length("alt_bases") - (F.col("ref_end") - F.col("ref_start"))
    zones = active.select("ci", "hap", (F.col("ref_start") + 1).alias("zone_from"), F.lead(F.col("ref_start") + 1).over(w).alias("zone_to"), F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("shift"), "ref_end", F.col("event_kind"))
    first = active.groupBy("ci", "hap").agg((F.min("ref_start") + 1).alias("zone_to"))
    both = contigs.select("ci", "len", F.explode(F.array(F.lit(0), F.lit(1))).alias("hap"))
    head = both.join(first, ["ci", "hap"], "left").select("ci", "hap", F.lit(0).cast("long").alias("zone_from"), "zone_to", F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("ref_end"), F.lit("none").alias("event_kind"))
    zones = zones.unionByName(head).join(contigs.select("ci", "len"), "ci").withColumn("zone_to", F.coalesce("zone_to", F.col("len") + 1)).where("zone_to > zone_from")
    met = relops.range_join(points, zones, ["ci"], point, "zone_from", "zone_to", 256)
    return met.withColumn(out, F.when((F.col("event_kind") == "deletion") & (F.col(point) < F.col("ref_end")), None).otherwise(F.col(point) + F.col("shift"))).drop("zone_from", "zone_to", "shift", "ref_end", "event_kind", "len")


def _place_sql(point: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(bool_or(e.event_kind = 'deletion' AND {point} < e.ref_end), false) THEN NULL ELSE {point} + CAST(coalesce(sum(length(alt_bases) - (ref_end - ref_start)), 0) AS BIGINT) END FROM events e WHERE e.ci = t.ci AND (e.mask >> t.hap) & 1 = 1 AND e.ref_start < {point})"""


@query(f"WITH {_VARIANTS}, {src.TARGETS_SQL}, asked AS (SELECT DISTINCT ci, hap, st FROM targets, (VALUES (0), (1)) AS h(hap)) SELECT ci, hap, st, {_place_sql('t.st')} AS hap_st FROM asked t")
def interval_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target starts on either haplotype."""
    points = src.targets(spark, sf_dir).select("ci", "st").distinct()
    return boundaries(points, src.contigs(spark, sf_dir), events_of(spark, sf_dir), "st", "hap_st").select("ci", "hap", "st", "hap_st")


@query(f"""WITH {_HAPS}, runs AS (SELECT ci, hap, hap_begin, hap_end, ref_begin, ref_begin - hap_begin AS offs FROM segments WHERE bases IS NULL OR ref_end > ref_begin),
marked AS (SELECT *, CASE WHEN lag(offs) OVER w = offs AND lag(hap_end) OVER w = hap_begin THEN 0 ELSE 1 END AS opens FROM runs WINDOW w AS (PARTITION BY ci, hap ORDER BY hap_begin)),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY ci, hap ORDER BY hap_begin) AS run FROM marked) SELECT ci, hap, min(hap_begin) AS hap_begin, max(hap_end) AS hap_end, min(ref_begin) AS ref_begin FROM grouped GROUP BY ci, hap, run""")
def projection_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs in which haplotype and reference advance together."""
    rows = haplotype_segments(spark, sf_dir).where(F.col("bases").isNull() | (F.col("ref_end") > F.col("ref_begin"))).withColumn("offs", F.col("ref_begin") - F.col("hap_begin"))
    w = Window.partitionBy("ci", "hap").orderBy("hap_begin")
    rows = rows.withColumn("opens", F.when((F.lag("offs").over(w) == F.col("offs")) & (F.lag("hap_end").over(w) == F.col("hap_begin")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("opens").over(w))
    return rows.groupBy("ci", "hap", "run").agg(F.min("hap_begin").alias("hap_begin"), F.max("hap_end").alias("hap_end"), F.min("ref_begin").alias("ref_begin")).drop("run")


def haplotype_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ci, hap, origin, inserted, code): classified sites of both haplotypes by the base they come from.

    The origin of an aligned base is its reference place; of an inserted base its anchor and offset.
    """
    parts = haplotype_segments(spark, sf_dir)
    haps = sequences(src.contigs(spark, sf_dir), parts)
    # Contexts look two bases away, so they are computed on haplotypes as if those were contigs.
    found = tiles.contexts(haps.select((F.col("ci") * 2 + F.col("hap")).alias("ci"), "seq", "len"))
    found = found.select(F.floor(F.col("ci") / 2).alias("ci"), (F.col("ci") % 2).cast("int").alias("hap"), F.col("pos").alias("hap_pos"), "code")
    met = relops.range_join(found, parts, ["ci", "hap"], "hap_pos", "hap_begin", "hap_end", 256)
    inserted = F.col("bases").isNotNull() & (F.col("ref_begin") == F.col("ref_end"))
    within = F.col("hap_pos") - F.col("hap_begin")
    return met.select("ci", "hap", F.when(inserted, F.col("ref_begin")).otherwise(F.col("ref_begin") + within).alias("origin"), F.when(inserted, within + 1).otherwise(0).cast("int").alias("inserted"), "code")


HAP_SITES_SQL = f"""{src.windows_sql('hap_bases', 'haplotypes', 'ci, hap', 5, '--')},
hap_codes AS (SELECT * FROM (SELECT ci, hap, pos AS hap_pos, CAST(CASE WHEN regexp_matches(near, '^..CG') THEN 1 WHEN regexp_matches(near, '^..C[ACT]G') THEN 3 WHEN regexp_matches(near, '^..C[ACT][ACT]') THEN 7
  WHEN regexp_matches(near, '^.CG') THEN 9 WHEN regexp_matches(near, '^C[AGT]G') THEN 11 WHEN regexp_matches(near, '^[AGT][AGT]G') THEN 15 END AS INTEGER) AS code FROM hap_bases) WHERE code IS NOT NULL),
hap_sites AS (SELECT c.ci, c.hap, CASE WHEN bases IS NOT NULL AND ref_begin = ref_end THEN ref_begin ELSE ref_begin + hap_pos - hap_begin END AS origin, CAST(CASE WHEN bases IS NOT NULL AND ref_begin = ref_end THEN hap_pos - hap_begin + 1 ELSE 0 END AS INTEGER) AS inserted, code
  FROM hap_codes c ASOF JOIN segments s ON c.ci = s.ci AND c.hap = s.hap AND c.hap_pos >= s.hap_begin)"""
_SITES = f"{_HAPS}, {SEQUENCES_SQL}, {HAP_SITES_SQL}"


@query(f"""WITH {_SITES}, a AS (SELECT * FROM hap_sites WHERE hap = 0), b AS (SELECT * FROM hap_sites WHERE hap = 1),
merged AS (SELECT coalesce(a.ci, b.ci) AS ci, coalesce(a.origin, b.origin) AS origin, coalesce(a.inserted, b.inserted) AS inserted, a.code AS code0, b.code AS code1 FROM a FULL JOIN b ON a.ci = b.ci AND a.origin = b.origin AND a.inserted = b.inserted)
SELECT ci, origin, inserted, code0 AS code, 'shared' AS allele FROM merged WHERE code0 = code1 UNION ALL SELECT ci, origin, inserted, code0, 'haplotype 0' FROM merged WHERE code0 IS NOT NULL AND code0 IS DISTINCT FROM code1 UNION ALL SELECT ci, origin, inserted, code1, 'haplotype 1' FROM merged WHERE code1 IS NOT NULL AND code0 IS DISTINCT FROM code1""")
def diploid_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of both haplotypes: shared where origin and context agree, else one row each.

    One aggregate by origin does the full outer merge: no self-join.
    """
    rows = haplotype_sites(spark, sf_dir).groupBy("ci", "origin", "inserted").agg(F.max(F.when(F.col("hap") == 0, F.col("code"))).alias("code0"), F.max(F.when(F.col("hap") == 1, F.col("code"))).alias("code1"))
    same = F.col("code0").isNotNull() & F.col("code1").isNotNull() & (F.col("code0") == F.col("code1"))
    one = lambda c, name: F.struct(F.col(c).alias("code"), F.lit(name).alias("allele"))
    lists = F.when(same, F.array(one("code0", "shared"))).otherwise(F.filter(F.array(one("code0", "haplotype 0"), one("code1", "haplotype 1")), lambda s: s["code"].isNotNull()))
    return rows.select("ci", "origin", "inserted", F.explode(lists).alias("s")).select("ci", "origin", "inserted", "s.code", "s.allele")


# Levels --------------------------------------------------------------------------------------------

_LEVELS = f"{src.CONTIGS_SQL}, {tiles.CONTEXTS_SQL}, {src.LEVELS_SQL}"
#: The level, in hundredths, where no profile defines one: fixed by context class.
DEFAULT = {"CG": 50, "CHG": 2, "CHH": 2}


def overlay(sites: DataFrame, levels: DataFrame) -> DataFrame:
    """Profile levels over defaults where position and context agree."""
    given = levels.select("ci", "pos", F.col("code").alias("given_code"), "level")
    rows = sites.join(given, ["ci", "pos"], "left")
    default = F.when(sq.context_class(F.col("code")) == "CG", DEFAULT["CG"] / 100).otherwise(DEFAULT["CHG"] / 100)
    good = (F.col("given_code") == F.col("code")) & F.col("level").isNotNull()
    return rows.select("ci", "pos", "code", F.when(good, F.col("level")).otherwise(default).alias("level"), F.when(good, "profile").otherwise("default").alias("source"))


_OVERLAY = f"{_LEVELS}, overlaid AS (SELECT ci, pos, c.code, CASE WHEN level IS NULL THEN CASE WHEN c.code IN (1, 9) THEN 0.5 ELSE 0.02 END ELSE level END::DOUBLE AS level, CASE WHEN level IS NULL THEN 'default' ELSE 'profile' END AS source FROM contexts c LEFT JOIN levels l USING (ci, pos))"


@query(f"WITH {_OVERLAY} SELECT ci, code, source, count(*) AS n, CAST(sum(CAST(round(level * 100) AS BIGINT)) AS BIGINT) AS hundredths FROM overlaid GROUP BY ALL")
def cgmap_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = tiles.contexts(src.contigs(spark, sf_dir))
    rows = overlay(sites, src.levels(sites))
    return rows.groupBy("ci", "code", "source").agg(F.count("*").alias("n"), F.sum(F.round(F.col("level") * 100).cast("long")).alias("hundredths"))


@query(f"WITH {src.CONTIGS_SQL}, {src.TARGETS_SQL}, {tiles.CONTEXTS_SQL} SELECT DISTINCT t.ci, st, strand, code, coalesce(code IS NOT NULL AND (strand = '.' OR (strand = '+') = (code < 8)), false) AS agrees FROM targets t LEFT JOIN contexts c ON t.ci = c.ci AND t.st = c.pos")
def bedmethyl_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED rows get their context from the reference; a stranded row must lie on its own strand's base."""
    rows = src.targets(spark, sf_dir).select("ci", "st", "strand").distinct()
    sites = tiles.contexts(src.contigs(spark, sf_dir)).withColumnRenamed("pos", "st")
    agrees = F.col("code").isNotNull() & ((F.col("strand") == ".") | ((F.col("strand") == "+") == (F.col("code") < 8)))
    return rows.join(sites, ["ci", "st"], "left").select("ci", "st", "strand", "code", F.coalesce(agrees, F.lit(False)).alias("agrees"))


def asm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele-specific rows: sites up to five bases after a substitution; some name a wrong allele."""
    sites = tiles.contexts(src.contigs(spark, sf_dir))
    near = src.variants(spark, sf_dir).where("kind = 0").select("ci", F.col("pos").alias("snp_pos"), "ref", "alt", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 5)).alias("pos"))
    rows = near.join(sites, ["ci", "pos"])
    wrong = F.when(F.col("pos") % 7 == 0, F.translate("alt", "ACGT", "TACG")).otherwise(F.col("alt"))
    return rows.select("ci", "pos", "code", "snp_pos", "ref", wrong.alias("alt"), ((F.col("pos") % 10) / 10.0).alias("ref_level"), ((F.col("snp_pos") % 9) / 10.0).alias("alt_level"))


_ASM = f"""{_VARIANTS}, {tiles.CONTEXTS_SQL}, asm AS (SELECT v.ci, c.pos, code, v.pos AS snp_pos, ref, CASE WHEN c.pos % 7 = 0 THEN translate(alt, 'ACGT', 'TACG') ELSE alt END AS alt, c.pos % 10 / 10.0::DOUBLE AS ref_level, v.pos % 9 / 10.0::DOUBLE AS alt_level
  FROM variants v JOIN contexts c ON v.ci = c.ci AND c.pos BETWEEN v.pos + 1 AND v.pos + 5 WHERE kind = 0)"""


@query(f"WITH {_ASM} SELECT a.ci, a.pos, a.snp_pos, coalesce(mask IN (1, 2), false) AS linked, mask FROM asm a LEFT JOIN variants v ON a.ci = v.ci AND a.snp_pos = v.pos AND a.ref = v.ref AND a.alt = v.alt")
def asm_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele-specific rows must name a heterozygous substitution exactly."""
    calls = src.variants(spark, sf_dir).select("ci", F.col("pos").alias("snp_pos"), "ref", "alt", "mask")
    rows = asm_rows(spark, sf_dir).join(calls, ["ci", "snp_pos", "ref", "alt"], "left")
    return rows.select("ci", "pos", "snp_pos", F.coalesce(F.col("mask").isin(1, 2), F.lit(False)).alias("linked"), "mask")


@query(f"""WITH {_ASM}, linked AS (SELECT a.*, mask FROM asm a JOIN variants v ON a.ci = v.ci AND a.snp_pos = v.pos AND a.ref = v.ref AND a.alt = v.alt WHERE mask IN (1, 2)),
split AS (SELECT ci, pos, CASE side WHEN 0 THEN 2 - mask ELSE mask - 1 END AS hap, CASE side WHEN 0 THEN ref_level ELSE alt_level END AS level, CASE side WHEN 0 THEN 'reference' ELSE 'alternate' END AS allele, snp_pos FROM linked, (VALUES (0), (1)) AS s(side))
SELECT ci, pos, snp_pos, hap, allele, level FROM split""")
def asm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked row becomes one on the reference allele's haplotype and one on the other."""
    calls = src.variants(spark, sf_dir).where("mask IN (1, 2)").select("ci", F.col("pos").alias("snp_pos"), "ref", "alt", "mask")
    rows = asm_rows(spark, sf_dir).join(calls, ["ci", "snp_pos", "ref", "alt"])
    side = lambda hap, name, level: F.struct(hap.cast("int").alias("hap"), F.lit(name).alias("allele"), F.col(level).alias("level"))
    both = F.explode(F.array(side(2 - F.col("mask"), "reference", "ref_level"), side(F.col("mask") - 1, "alternate", "alt_level"))).alias("s")
    return rows.select("ci", "pos", "snp_pos", both).select("ci", "pos", "snp_pos", "s.hap", "s.allele", "s.level")


_POOL = f"""{_LEVELS}, classed AS (SELECT *, code & 7 AS class FROM levels), pool AS (SELECT ci, class, level AS picked, row_number() OVER (PARTITION BY ci, class ORDER BY pos) - 1 AS rank, count(*) OVER (PARTITION BY ci, class) AS n FROM classed WHERE level IS NOT NULL),
ask AS (SELECT c.ci, c.pos, c.class, p.n FROM classed c JOIN (SELECT DISTINCT ci, class, n FROM pool) p USING (ci, class) WHERE level IS NULL)"""


@query(f"WITH {_POOL}, {sqlgen.draws('d', 'ask', CATALOG_SEED, rng.METHYLATION_LEVEL, 'ci', 'pos', '18446744073709551615')}, ranks AS (SELECT ci, pos, class, {sqlgen.bounded('n')} AS rank FROM d) SELECT ci, pos, class, picked FROM ranks JOIN pool USING (ci, class, rank)")
def context_pool_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undefined levels are drawn, with replacement, from the contig's defined ones of that class."""
    rows = src.levels(tiles.contexts(src.contigs(spark, sf_dir))).withColumn("class", F.col("code").bitwiseAND(7))
    pool = rows.where("level IS NOT NULL").select("ci", "class", F.col("pos").alias("at"), F.col("level").alias("picked"))
    sizes = pool.groupBy("ci", "class").agg(F.count("*").alias("n"))
    ask = rows.where("level IS NULL").select("ci", "pos", "class").join(sizes, ["ci", "class"])
    ask = ask.withColumn("w", rng.draw(CATALOG_SEED, rng.METHYLATION_LEVEL, F.col("ci"), F.col("pos"), F.lit(-1))).select("ci", "pos", "class", rng.bounded(F.col("w"), F.col("n")).alias("rank"))
    return relops.rank_select(ask, pool, ["ci", "class"], "rank", ["at"], F.floor(F.col("at") / tiles.CORE)).select("ci", "pos", "class", "picked")


# Draws over every base -----------------------------------------------------------------------------

MUTATION_RATE, INDEL_RATE = 0.02, 0.15


def mutated(contigs: DataFrame, rate: float = MUTATION_RATE) -> DataFrame:
    """(ci, pos, base, indel): the bases that mutate, before neighbours suppress each other."""

    def kernel(x: np.ndarray, at: int, a: int, b: int, n: int, key: np.ndarray) -> dict[str, np.ndarray]:
        pos = np.flatnonzero(x[a - at : b - at] < 4) + a
        pos = pos[rng.uniform(rng.block(np.broadcast_to(key, pos.shape), pos, np.zeros(len(pos)))) < rate]
        indel = rng.uniform(rng.block(np.broadcast_to(key, pos.shape), pos, np.ones(len(pos)))) < INDEL_RATE
        return {"pos": pos.astype(np.int64), "base": x[pos - at].astype(np.int32), "indel": indel}

    return tiles.per_tile_keyed(tiles.tiles(contigs, 0), kernel, CATALOG_SEED, rng.MUTATION, "ci long, pos long, base int, indel boolean")


_DENOVO_HITS = f"{src.windows_sql('places', 'contigs', 'ci', 1)}, ask AS (SELECT ci, pos, near AS b FROM places WHERE near <> 'N'), {sqlgen.draws('d', 'ask', CATALOG_SEED, rng.MUTATION, 'ci', 'pos', '0')}, hit AS (SELECT ci, pos, b FROM d WHERE {sqlgen.uniform()} < {MUTATION_RATE})"
_DENOVO = f"{_DENOVO_HITS}, {sqlgen.draws('e', 'hit', CATALOG_SEED, rng.MUTATION, 'ci', 'pos', '1')}"


@query(f"WITH {src.CONTIGS_SQL}, {_DENOVO} SELECT ci, pos, CAST(strpos('ACGT', b) - 1 AS INTEGER) AS base, {sqlgen.uniform()} < {INDEL_RATE} AS indel FROM e")
def denovo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutated(src.contigs(spark, sf_dir))
