"""Queries on contigs, random numbers and allocation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import philox as rng
from ..functions import seq as sq
from ..operators import relops
from ..sources import derived as src
from . import sqlgen, tiles
from .registry import query



@dataclass(frozen=True)
class Params:
    """What a run is drawn with; the defaults are those of the registered queries."""

    seed: int = 42
    catalog_seed: int = 7
    read: int = 20
    insert: int = 60
    max_n: int = 8
    total: int = 20000
    conversion: float = 0.95
    error: float = 0.02
    phred: int = 40


DEFAULTS = Params()
SEED, CATALOG_SEED = DEFAULTS.seed, DEFAULTS.catalog_seed
READ, INSERT, MAX_N, BINS, TOTAL = DEFAULTS.read, DEFAULTS.insert, DEFAULTS.max_n, 11, DEFAULTS.total


@query(f"""WITH {src.CONTIGS_SQL} SELECT ci, name, len, sha256(seq) AS sha256, CAST(len - length(translate(seq, 'CG', '')) AS BIGINT) AS gc, CAST(len - length(replace(seq, 'N', '')) AS BIGINT) AS n_unknown FROM contigs""")
def contig_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = src.contigs(spark, sf_dir)
    return c.select("ci", "name", "len", F.sha2("seq", 256).alias("sha256"), sq.count_of(F.col("seq"), "CG").alias("gc"), sq.count_of(F.col("seq"), "N").alias("n_unknown"))


@query(f"""WITH {src.CONTIGS_SQL} SELECT ci, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS reverse_complement FROM contigs""")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.contigs(spark, sf_dir).select("ci", sq.reverse_complement(F.col("seq")).alias("reverse_complement"))


@query(f"""WITH {src.CONTIGS_SQL}, {src.TARGETS_SQL} SELECT DISTINCT ci, st, substr(seq, CAST(st + 1 AS INTEGER), {READ}) AS mate1, reverse(translate(substr(seq, CAST(st + {INSERT} - {READ} + 1 AS INTEGER), {READ}), 'ACGTN', 'TGCAN')) AS mate2
FROM targets JOIN contigs USING (ci) WHERE st + {INSERT} <= len""")
def mate_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.targets(spark, sf_dir).select("ci", "st").distinct().join(src.contigs(spark, sf_dir), "ci").where(F.col("st") + INSERT <= F.col("len"))
    end = F.col("st") + INSERT
    return t.select("ci", "st", sq.piece(F.col("seq"), F.col("st"), F.col("st") + READ).alias("mate1"), sq.reverse_complement(sq.piece(F.col("seq"), end - READ, end)).alias("mate2"))


@query(f"WITH {src.CONTIGS_SQL}, {tiles.CONTEXTS_SQL} SELECT ci, pos, code FROM contexts")
def methylation_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.contexts(src.contigs(spark, sf_dir))


@query(f"""WITH {src.CONTIGS_SQL}, {tiles.CONTEXTS_SQL} SELECT ci, CASE WHEN code IN (1, 9) THEN 'CG' WHEN code IN (3, 11) THEN 'CHG' ELSE 'CHH' END AS context, count(*) FILTER (code < 8) AS forward, count(*) FILTER (code > 8) AS reverse FROM contexts GROUP BY 1, 2""")
def context_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = tiles.contexts(src.contigs(spark, sf_dir))
    return sites.groupBy("ci", sq.context_class(F.col("code")).alias("context")).agg(F.count_if(F.col("code") < 8).alias("forward"), F.count_if(F.col("code") > 8).alias("reverse"))


_STARTS = tiles.valid_starts_sql(READ, INSERT, MAX_N)


@query(f"WITH {src.CONTIGS_SQL}, {_STARTS} SELECT ci, min(pos) AS first, max(pos) AS last FROM (SELECT ci, pos, pos - row_number() OVER (PARTITION BY ci ORDER BY pos) AS run FROM starts) GROUP BY ci, run")
def valid_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid starts as runs of consecutive places."""
    rows = tiles.valid_runs(src.contigs(spark, sf_dir), READ, INSERT, MAX_N)  # only runs cut by a tile's end merge
    return relops.islands(rows, ["ci"], "pos", "stop").select("ci", F.col("pos").alias("first"), (F.col("stop") - 1).alias("last"))


@query(f"WITH {src.CONTIGS_SQL}, {_STARTS} SELECT ci, count(*) AS weight FROM starts GROUP BY ci")
def start_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tiles.start_counts(src.contigs(spark, sf_dir), READ, INSERT, MAX_N)
    return counts.groupBy("ci").agg(F.sum("n").alias("weight"))


_BIN_SQL = f"gc * {BINS - 1} // {INSERT} + CASE WHEN gc * {BINS - 1} % {INSERT} * 2 >= {INSERT} THEN 1 ELSE 0 END"


@query(f"WITH {src.CONTIGS_SQL}, {_STARTS} SELECT ci, {_BIN_SQL} AS bin, count(*) AS n FROM starts GROUP BY ALL")
def gc_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tiles.gc_counts(src.contigs(spark, sf_dir), READ, INSERT, MAX_N, BINS)
    return counts.groupBy("ci", F.col("pos").alias("bin")).agg(F.sum("n").alias("n"))


#: The target share of each GC bin: a fixed example profile.
GC_PROFILE = (0.0, 0.02, 0.22, 0.446, 0.3, 0.01, 0.004, 0.0, 0.0, 0.0, 0.0)
_PROFILE_SQL = "profile AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {p}::DOUBLE)" for i, p in enumerate(GC_PROFILE)) + ") AS t(bin, p))"


def calibration(opportunities: DataFrame, profile: DataFrame) -> DataFrame:
    """(bin, n, p, acceptance): the share p / n of each reachable bin over the largest one."""
    # One row a bin on either side.
    total = opportunities.groupBy("bin").agg(F.sum("n").alias("n")).join(profile, "bin")
    ratio = total.withColumn("ratio", F.col("p") / F.col("n"))
    return ratio.withColumn("acceptance", F.col("ratio") / F.max("ratio").over(Window.partitionBy(F.lit(0)))).drop("ratio")


def gc_profile(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(GC_PROFILE)], "bin long, p double")


_CALIBRATION_SQL = f"{_PROFILE_SQL}, opportunities AS (SELECT ci, {_BIN_SQL} AS bin, count(*) AS n FROM starts GROUP BY ALL), ratios AS (SELECT bin, CAST(sum(n) AS BIGINT) AS n, any_value(p) AS p FROM opportunities JOIN profile USING (bin) GROUP BY bin), calibration AS (SELECT bin, n, p, (p / n) / (SELECT max(p / n) FROM ratios) AS acceptance FROM ratios)"


@query(f"WITH {src.CONTIGS_SQL}, {_STARTS}, {_CALIBRATION_SQL} SELECT bin, n, p, round(acceptance, 9) AS acceptance FROM calibration")
def gc_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(gc_opportunities(spark, sf_dir), gc_profile(spark)).withColumn("acceptance", F.round("acceptance", 9))


@query(f"WITH {src.CONTIGS_SQL}, {_STARTS}, {_CALIBRATION_SQL} SELECT ci, round(sum(o.n * acceptance), 4) AS weight FROM opportunities o JOIN calibration USING (bin) GROUP BY ci")
def gc_contig_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = gc_opportunities(spark, sf_dir)
    c = calibration(o, gc_profile(spark)).select("bin", "acceptance")
    return o.join(F.broadcast(c), "bin").groupBy("ci").agg(F.round(F.sum(F.col("n") * F.col("acceptance")), 4).alias("weight"))


def hamilton_sql(source: str, total: int, weight: str, order: str) -> str:
    return f"""hamilton AS (SELECT * EXCLUDE (quota, rest), CAST(quota + CASE WHEN {weight} > 0 AND row_number() OVER (ORDER BY {weight} > 0 DESC, rest DESC, {order}) <= {total} - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats
  FROM (SELECT *, {weight}::HUGEINT * {total} // sum({weight}) OVER () AS quota, {weight}::HUGEINT * {total} % sum({weight}) OVER () AS rest FROM {source}))"""


def hamilton_real_sql(source: str, total: int, weight: str, order: str) -> str:
    return f"""hamilton AS (SELECT * EXCLUDE (share, quota), CAST(quota + CASE WHEN {weight} > 0 AND row_number() OVER (ORDER BY {weight} > 0 DESC, round(share - quota, 9) DESC, {order}) <= {total} - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats
  FROM (SELECT *, floor(round(share, 9)) AS quota FROM (SELECT *, {weight} / sum({weight}) OVER () * {total} AS share FROM {source})))"""


def calibrated_weights(opportunities: DataFrame, accept: DataFrame, keys: list[str]) -> DataFrame:
    """(ci, mass): the sum over bins, in their order, of eligible counts times acceptance."""
    rows = opportunities.join(F.broadcast(accept), keys)  # one row a bin
    lists = rows.groupBy("ci").agg(F.sort_array(F.collect_list(F.struct(*keys, (F.col("n") * F.col("acceptance")).alias("m")))).alias("l"))
    return lists.select("ci", F.aggregate(F.col("l.m"), F.lit(0.0), lambda a, x: a + x).alias("mass"))


_WEIGHTS_SQL = "weights AS (SELECT ci, count(*) AS weight FROM starts GROUP BY ci)"
SEATS_SQL = f"{src.CONTIGS_SQL}, {_STARTS}, {_WEIGHTS_SQL}, {hamilton_sql('weights', TOTAL, 'weight', 'ci')}"


@query(f"WITH {SEATS_SQL} SELECT ci, weight, seats FROM hamilton")
def hamilton_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.hamilton(start_weights(spark, sf_dir), TOTAL, "weight", "ci")


@query(f"""WITH {src.CONTIGS_SQL}, w AS (SELECT ci, (len % 97) / 64.0::DOUBLE AS weight FROM contigs), s AS (SELECT *, weight / sum(weight) OVER () * 1024 AS share FROM w)
SELECT ci, CAST(floor(share) + CASE WHEN weight > 0 AND row_number() OVER (ORDER BY weight > 0 DESC, round(share - floor(share), 9) DESC, ci) <= 1024 - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS seats FROM s""")
def hamilton_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = src.contigs(spark, sf_dir).select("ci", ((F.col("len") % 97) / 64.0).alias("weight"))
    return relops.hamilton_real(w, 1024, "weight", "ci").select("ci", "seats")


ISLANDS_SQL = "islands AS (SELECT ci, min(st) AS st, max(en) AS en FROM (SELECT *, sum(opens) OVER (PARTITION BY ci ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT ci, st, en, CASE WHEN st <= max(en) OVER (PARTITION BY ci ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT ci, st, en FROM targets))) GROUP BY ci, island)"


@query(f"WITH {src.CONTIGS_SQL}, {src.TARGETS_SQL}, {ISLANDS_SQL} SELECT ci, st, en FROM islands")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.islands(src.targets(spark, sf_dir).select("ci", "st", "en").distinct(), ["ci"], "st", "en")


@query(f"WITH {src.CONTIGS_SQL}, {src.TARGETS_SQL}, {ISLANDS_SQL} SELECT depth, CAST(ceil(sum(en - st) * depth / {2 * READ}) AS BIGINT) AS fragments FROM islands, (VALUES (0.5::DOUBLE), (10.0), (30.0)) AS t(depth) GROUP BY depth")
def depth_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments for a depth over the union of the targets, rounded up."""
    bases = interval_union(spark, sf_dir).agg(F.sum(F.col("en") - F.col("st")).alias("bases"))
    depths = F.explode(F.array(*[F.lit(x) for x in (0.5, 10.0, 30.0)])).alias("depth")
    return bases.select("bases", depths).select("depth", F.ceil(F.col("bases") * F.col("depth") / (2 * READ)).alias("fragments"))


_ADDRESS_SQL = "address AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS contig FROM lineitem)"


def _address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _words(rows: DataFrame, stage: int) -> DataFrame:
    return rows.withColumn("w", rng.draw(SEED, stage, F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")))


_DRAWS = "WITH " + _ADDRESS_SQL + ", " + sqlgen.draws("d", "address", SEED, rng.QUALITY, "contig", "l_orderkey", "l_linenumber")


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, w0, w1, w2, w3 FROM d")
def philox_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", "w.w0", "w.w1", "w.w2", "w.w3")


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, {sqlgen.uniform()} AS u, {sqlgen.uniform(1)} AS v FROM d")
def uniform01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", rng.uniform01(F.col("w")).alias("u"), rng.uniform01(F.col("w"), 1).alias("v"))


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, {sqlgen.coin('(l_partkey % 11 / 10.0::DOUBLE)')} AS hit FROM d")
def bernoulli_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", rng.bernoulli(F.col("w"), F.col("l_partkey") % 11 / 10.0).alias("hit"))


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, {sqlgen.bounded('l_partkey + 1')} AS pick FROM d")
def bounded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", rng.bounded(F.col("w"), F.col("l_partkey") + 1).alias("pick"))


def normal_of(w):
    """Box-Muller on a block's two pairs, in DOUBLE."""
    top = lambda k: F.shiftleft(w[f"w{k + 1}"], 21).bitwiseOR(F.shiftright(w[f"w{k}"], 11)).cast("double")
    return F.sqrt(F.lit(-2.0) * F.log((top(0) + 1) * F.lit(2.0**-53))) * F.cos(F.lit(2.0) * F.pi() * (top(2) * F.lit(2.0**-53)))


_NORMAL = f"(sqrt(-2.0 * ln((((w1 << 21) | (w0 >> 11))::DOUBLE + 1) * {2.0**-53!r})) * cos(2.0 * pi() * (((w3 << 21) | (w2 >> 11))::DOUBLE * {2.0**-53!r})))"


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, round({_NORMAL}, 6) AS z FROM d")
def normal_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", F.round(normal_of(F.col("w")), 6).alias("z"))


def insert_length(z, least: int, mean: int, most: int, sd: float):
    """mean + trunc(sd * z), clamped."""
    shift = F.lit(sd) * z
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(mean) + F.when(shift >= 0, F.floor(shift)).otherwise(F.ceil(shift)))).cast("long")


@query(f"{_DRAWS} SELECT l_orderkey, l_linenumber, CAST(greatest(100, least(1000, 400 + trunc(25.0 * {_NORMAL}))) AS BIGINT) AS insert_length FROM d")
def insert_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(_address(spark, sf_dir), rng.QUALITY).select("l_orderkey", "l_linenumber", insert_length(normal_of(F.col("w")), 100, 400, 1000, 25.0).alias("insert_length"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 7 AS kind, (l_linenumber % 7)::BIGINT << 60 | l_partkey * 4 + l_suppkey % 4 AS entity, l_linenumber % 7 AS kind_back, l_partkey * 4 + l_suppkey % 4 AS payload_back FROM lineitem""")
def site_entity_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of sites, and what they are decoded to."""
    kind = F.col("l_linenumber") % 7
    rows = _address(spark, sf_dir).withColumn("entity", sq.site_entity(kind, F.col("l_partkey") * 4 + F.col("l_suppkey") % 4))
    back, payload = sq.site_parts(F.col("entity"))
    return rows.select("l_orderkey", "l_linenumber", kind.alias("kind"), "entity", back.cast("int").alias("kind_back"), payload.alias("payload_back"))


@query("SELECT l_orderkey, l_linenumber, l_partkey || ':' || (l_suppkey + 1) || '-' || greatest(l_suppkey + l_linenumber, l_suppkey + 1) || ':' || lower(to_hex(l_orderkey)) AS read_name FROM lineitem")
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _address(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", sq.read_name(F.col("l_partkey").cast("string"), F.col("l_suppkey"), F.col("l_suppkey") + F.col("l_linenumber"), F.col("l_orderkey")).alias("read_name"))
