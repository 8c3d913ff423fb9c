"""Genomic inputs derived from the plain tables, deterministically (there is no genome among them).

Texts become contigs: ASCII letters map cyclically to A, C, G, T, everything else to N.  Line items become
targets and variants by modular arithmetic on contig coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import piece

#: Fixed map: letters by place in the alphabet modulo four; '#' (any other character) becomes N.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#"
BASES = "ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACN"
#: Targets need room: contigs longer than this hold them.
ROOM = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text):
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", "#"), LETTERS, BASES)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ci, name, seq, len): every whole text that is not empty; ci is the document's id."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ci"), dna(F.col("text")).alias("seq"))
    return docs.select("ci", F.concat(F.lit("doc"), F.col("ci")).alias("name"), "seq", F.length("seq").cast("long").alias("len")).where("len > 0")


CONTIGS_SQL = f"""contigs AS (SELECT ci, 'doc' || ci AS name, seq, CAST(length(seq) AS BIGINT) AS len FROM (
  SELECT doc_id AS ci, translate(regexp_replace(text, '[^A-Za-z]', '#', 'g'), '{LETTERS}', '{BASES}') AS seq FROM documents)
  WHERE length(seq) > 0)"""


def windows_sql(name: str, source: str, keys: str, width: int, pad: str = "") -> str:
    """``name`` (keys, pos, near): the ``width`` bases from each place of ``source`` on, with ``pad`` before and after.

    Cut by way of blocks, as each cut of a long text walks to its place.
    """
    whole = f"'{pad}' || seq || '{pad}'" if pad else "seq"
    n = f"greatest(0, length(seq) + {2 * len(pad)} - {width} + 1)"
    return f"""{name}_blocks AS (SELECT {keys}, {n} AS n, k AS at0, substr({whole}, CAST(k + 1 AS INTEGER), {1000 + width}) AS part FROM {source}, unnest(range(0, {n}, 1000)) AS t(k)),
{name} AS (SELECT {keys}, at0 + j AS pos, substr(part, CAST(j + 1 AS INTEGER), {width}) AS near FROM {name}_blocks, unnest(range(least(1000, n - at0))) AS t(j))"""


def _on_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the contig their order falls on, and its length; its bases do not travel with them."""
    docs = contigs(spark, sf_dir).select("ci", "len")
    n = _table(spark, sf_dir, "documents").select(F.max("doc_id").alias("top"))
    items = _table(spark, sf_dir, "lineitem").withColumn("h", F.col("l_partkey") * 31 + F.col("l_linenumber") * 17 + F.col("l_orderkey"))
    # One row, of one number: the bound of this broadcast is proven.
    items = items.crossJoin(F.broadcast(n)).withColumn("ci", F.col("l_orderkey") % (F.col("top") + 1))
    return items.join(docs, "ci")


_ITEMS_SQL = "(SELECT *, l_partkey * 31 + l_linenumber * 17 + l_orderkey AS h, l_orderkey % (SELECT max(doc_id) + 1 FROM documents) AS ci FROM lineitem) JOIN contigs USING (ci)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ci, st, en, strand, score): distinct stranded intervals with an integer score."""
    h, n = F.col("h"), F.col("len") - ROOM
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "N", "-").otherwise(".")
    rows = _on_contig(spark, sf_dir).where(F.col("len") > ROOM).select("ci", (h % n).alias("st"), (h % n + 1 + F.col("l_suppkey") % 20).alias("en"), strand.alias("strand"), F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy("ci", "st", "en", "strand").agg(F.max("q").alias("score"))


TARGETS_SQL = f"""targets AS (SELECT ci, st, en, strand, max(q) AS score FROM (
  SELECT ci, h % (len - {ROOM}) AS st, h % (len - {ROOM}) + 1 + l_suppkey % 20 AS en,
    CASE l_returnflag WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE '.' END AS strand, CAST(l_quantity AS BIGINT) AS q FROM {_ITEMS_SQL} WHERE len > {ROOM}) GROUP BY ALL)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ci, pos, ref, alt, mask, kind): at most one event a bin of ten bases, as in a sorted call file.

    kind 0 is a substitution, 1 an insertion after the base, 2 a deletion of the two bases after it; events
    that touch an N are dropped.  ref and alt are spelt as a call file does, with the anchor base.
    """
    h = F.col("h")
    pos = F.floor((h % F.col("len")) / 10) * 10 + 5
    rows = _on_contig(spark, sf_dir).select("ci", "len", pos.alias("pos"), (F.lit(1) + F.col("l_suppkey") % 3).alias("mask"), (F.col("l_linenumber") % 3).alias("kind")).where(F.col("pos") + 5 < F.col("len"))
    rows = rows.groupBy("ci", "pos").agg(F.min("mask").alias("mask"), F.min("kind").alias("kind"))
    # Places meet their contig as one list each.
    lists = rows.groupBy("ci").agg(F.collect_list(F.struct("pos", "mask", "kind")).alias("places"))
    whole = contigs(spark, sf_dir).select("ci", F.col("seq").cast("binary").alias("bytes")).join(lists, "ci")
    cut = F.transform("places", lambda x: F.struct(x["pos"].alias("pos"), F.substring(F.col("bytes"), (x["pos"] + 1).cast("int"), F.lit(3)).cast("string").alias("near"), x["mask"].alias("mask"), x["kind"].alias("kind")))
    rows = whole.select("ci", F.explode(cut).alias("x")).select("ci", "x.*")
    rows = rows.where(F.when(F.col("kind") == 2, ~F.col("near").contains("N")).otherwise(~F.substring("near", 1, 1).contains("N")))
    first = F.substring("near", 1, 1)
    ref = F.when(F.col("kind") == 2, F.col("near")).otherwise(first)
    alt = F.when(F.col("kind") == 0, F.translate(first, "ACGT", "CGTA")).when(F.col("kind") == 1, F.concat(first, F.translate(first, "ACGT", "GTAC"), F.lit("T"))).otherwise(first)
    return rows.select("ci", "pos", ref.alias("ref"), alt.alias("alt"), F.col("mask").cast("int").alias("mask"), F.col("kind").cast("int").alias("kind"))


VARIANTS_SQL = f"""variants AS (SELECT ci, pos, CASE kind WHEN 2 THEN near ELSE substr(near, 1, 1) END AS ref,
    CASE kind WHEN 0 THEN translate(substr(near, 1, 1), 'ACGT', 'CGTA') WHEN 1 THEN substr(near, 1, 1) || translate(substr(near, 1, 1), 'ACGT', 'GTAC') || 'T' ELSE substr(near, 1, 1) END AS alt,
    CAST(mask AS INTEGER) AS mask, CAST(kind AS INTEGER) AS kind FROM (
  SELECT ci, pos, near, min(mask) AS mask, min(kind) AS kind FROM (
    SELECT ci, len, (h % len) // 10 * 10 + 5 AS pos, substr(seq, CAST((h % len) // 10 * 10 + 6 AS INTEGER), 3) AS near, 1 + l_suppkey % 3 AS mask, l_linenumber % 3 AS kind FROM {_ITEMS_SQL})
  WHERE pos + 5 < len GROUP BY ci, pos, near)
  WHERE CASE kind WHEN 2 THEN NOT contains(near, 'N') ELSE substr(near, 1, 1) <> 'N' END)"""


def levels(sites: DataFrame) -> DataFrame:
    """(ci, pos, code, level) of a third of the classified sites; a level is null at every eleventh place."""
    chosen = sites.where((F.col("pos") * 7 + F.col("ci")) % 3 == 0)
    return chosen.select("ci", "pos", "code", F.when(F.col("pos") % 11 == 0, None).otherwise((F.col("pos") * 13) % 101 / 100.0).alias("level"))


LEVELS_SQL = "levels AS (SELECT ci, pos, code, CASE WHEN pos % 11 = 0 THEN NULL ELSE ((pos * 13) % 101) / 100.0::DOUBLE END AS level FROM contexts WHERE (pos * 7 + ci) % 3 = 0)"
