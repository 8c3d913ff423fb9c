"""Readers of the genomic text formats, each strict: one bad row fails the read, nothing is guessed.

All return DataFrames with 0-based half-open coordinates.  Checks are queries over the rows; only the first
offending row is ever brought to the driver.  Small models (JSON, profiles) are read on the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODEL_BYTES = 8 * 1024 * 1024


class FormatError(ValueError):
    """A file breaks its format."""


def _require(rows: DataFrame, good: Column, what: str) -> DataFrame:
    bad = rows.where(~F.coalesce(good, F.lit(False))).limit(1).collect()
    if bad:
        raise FormatError(f"{what}: {bad[0].asDict()}")
    return rows


def _lines(spark: SparkSession, path: str, skip: str = "^(#|track|browser|\\s*$)") -> DataFrame:
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("_at"))
    return rows.where(~F.col("value").rlike(skip))


def _fields(rows: DataFrame, names: list[str], what: str) -> DataFrame:
    rows = rows.select("_at", F.split("value", "\t").alias("f"))
    _require(rows, F.size("f") == len(names), f"{what}: not {len(names)} fields")
    return rows.select("_at", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def _unsigned(name: str) -> Column:
    return F.when(F.col(name).rlike("^(0|[1-9][0-9]{0,9})$"), F.col(name).cast("long"))


def u64(text: str) -> int:
    """A decimal from 0 to 2**64 - 1 without sign, blanks or leading zeros."""
    if not text.isascii() or not text.isdigit() or len(text) > 1 and text[0] == "0" or int(text) >= 2**64:
        raise FormatError(f"not an unsigned 64-bit number: {text!r}")
    return int(text)


def _in_order(rows: DataFrame, contig: str, pos: str, what: str) -> DataFrame:
    """``rows``, which must follow the contigs' order, their positions strictly increasing.

    Each partition tells, of each contig it sees, its first and last position; only these few rows are compared
    across partitions, in file order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, at, good, newest = {}, {}, {}, True, None
        for batch in batches:
            c, p, a = (batch[k].to_numpy(zero_copy_only=False) for k in ("c", "p", "a"))
            if not len(c):
                continue
            same = c[1:] == c[:-1]
            good &= bool((p[1:][same] > p[:-1][same]).all())
            for k in np.concatenate(([0], np.flatnonzero(~same) + 1)).tolist():
                here = int(c[k])
                if newest is not None and (here < newest or here == newest and p[k] <= last[here]):
                    good = False
                first.setdefault(here, int(p[k]))
                at.setdefault(here, int(a[k]))
                newest = here
                until = np.flatnonzero(~same[k:])
                last[here] = int(p[k + until[0] if len(until) else len(c) - 1])
        yield pa.record_batch([pa.array(list(first), pa.int64()), pa.array(list(first.values()), pa.int64()), pa.array(list(last.values()), pa.int64()), pa.array(list(at.values()), pa.int64()), pa.array([good] * len(first), pa.bool_())], ["c", "first", "last", "at", "good"])

    seen = rows.select(F.col(contig).cast("long").alias("c"), F.col(pos).cast("long").alias("p"), F.col("_at").alias("a")).mapInArrow(run, "c long, first long, last long, at long, good boolean")
    every = Window.partitionBy(F.lit(0)).orderBy("at")  # a few rows a partition
    seen = seen.withColumn("c_before", F.lag("c").over(every)).withColumn("last_before", F.lag("last").over(every))
    after = F.col("c_before").isNull() | (F.col("c") > F.col("c_before")) | (F.col("c") == F.col("c_before")) & (F.col("first") > F.col("last_before"))
    _require(seen, F.col("good") & after, f"{what}: rows are out of order")
    return rows


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig_index, name, length, sha256, seq): records in file order, upper case, only A, C, G, T, N."""
    # A record begins where a line begins with '>'; one inside a header line is a part of it.
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("at", F.monotonically_increasing_id())
    opens = rows.agg(F.min_by("value", "at").alias("v")).where("v IS NOT NULL")
    _require(opens, F.col("v").startswith(">"), "the file does not begin with a record")
    rows = rows.withColumn("value", F.regexp_replace("value", "^>", "")).where("trim(value) <> ''")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    rows = rows.select("at", F.split(header, r"[ \t]")[0].alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*\r?\n?", ""), r"\r?\n|\r$", "")).alias("seq"))
    _require(rows, F.col("name") != "", "a record without a name")
    _require(rows, F.col("seq").rlike("^[ACGTN]+$"), "a sequence is empty or has other letters")
    _require(rows.groupBy("name").count(), F.col("count") == 1, "a name occurs twice")
    index = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1
    order = rows.select("at").withColumn("contig_index", index.cast("int"))  # one small row a contig
    return rows.join(order, "at").select("contig_index", "name", F.length("seq").cast("long").alias("length"), F.sha2("seq", 256).alias("sha256"), "seq")


def _indexed(rows: DataFrame, contigs: DataFrame, name: str, what: str) -> DataFrame:
    known = contigs.select(F.col("name").alias(name), F.col("contig_index").alias("ci"), "length")
    rows = rows.join(known, name, "left")
    _require(rows, F.col("ci").isNotNull(), f"{what}: an unknown contig")
    return rows


def vcf(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, pos, ref, alt, id, phased, mask): one sample, two alleles, in contig order, positions strictly
    increasing; hom-ref records go.

    mask is null for an unphased heterozygous call, whose haplotype a later draw decides.  An id is unique: a
    missing one is made of the contig's index and the record's number among its calls, and one that comes again
    gets that address as well.
    """
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    rows = _fields(_lines(spark, path), names, "variant calls")
    rows = _indexed(rows, contigs, "chrom", "variant calls")
    rows = _require(rows.withColumn("pos", _unsigned("pos") - 1), (F.col("pos") >= 0) & (F.col("pos") < F.col("length")), "a position is outside its contig")
    _in_order(rows, "ci", "pos", "variant calls")
    _require(rows, F.upper("ref").rlike("^[ACGT]+$") & F.upper("alt").rlike("^[ACGT]+$"), "an allele is not of A, C, G, T")
    keys, values = F.split("format", ":"), F.split("sample", ":")
    _require(rows, (F.size(keys) == F.size(values)) & (F.array_position(keys, "GT") > 0), "the sample does not follow its format")
    rows = rows.withColumn("gt", F.element_at(values, F.array_position(keys, "GT").cast("int")))
    _require(rows, F.col("gt").rlike("^[01][|/][01]$"), "a genotype is not diploid and biallelic")
    first, second = F.substring("gt", 1, 1).cast("int"), F.substring("gt", 3, 1).cast("int")
    rows = rows.withColumn("phased", F.substring("gt", 2, 1) == "|").withColumn("both", first + 2 * second)
    mask = F.when(F.col("both") == 3, 3).when(F.col("phased"), F.col("both"))
    rows = rows.where("both > 0").select("ci", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), "id", "phased", mask.alias("mask"))
    return unique_ids(rows)


def unique_ids(calls: DataFrame, prefix: str = "vcf_") -> DataFrame:
    """``calls`` (ci, pos, id, ...) with an id that is no other's: the address is the contig's index over the call's number."""
    number = F.row_number().over(Window.partitionBy("ci").orderBy("pos")).cast("long") - 1
    address = F.lower(F.hex(F.shiftleft(F.col("ci").cast("long"), 32).bitwiseOR(number)))
    rows = calls.withColumn("_address", address)
    rows = rows.withColumn("id", F.when(F.col("id").isin("", ".") | F.col("id").isNull(), F.concat(F.lit(prefix), "_address")).otherwise(F.col("id")))
    again = F.row_number().over(Window.partitionBy("id").orderBy("ci", "pos")) > 1
    rows = rows.withColumn("id", F.when(again, F.concat_ws("@", "id", "_address")).otherwise(F.col("id")))
    _require(rows.groupBy("id").count(), F.col("count") == 1, "a variant id cannot be made unique")
    return rows.select(*calls.columns)


#: Context code by name and strand base: fixed values.
_CODE = {("CG", "C"): 1, ("CG", "G"): 9, ("CHG", "C"): 3, ("CHG", "G"): 11, ("CHH", "C"): 7, ("CHH", "G"): 15}


def _code(context: str, base: str) -> Column:
    out = F.lit(None).cast("int")
    for (name, nucleotide), code in _CODE.items():
        out = F.when((F.col(context) == name) & (F.col(base) == nucleotide), code).otherwise(out)
    return out


def cgmap(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, pos, code, level): eight fields; 'na' is an undefined level; positions increase by contig."""
    rows = _fields(_lines(spark, path), ["chrom", "base", "pos", "context", "dinuc", "level", "mc", "nc"], "levels")
    rows = _indexed(rows, contigs, "chrom", "levels").withColumn("pos", _unsigned("pos") - 1).withColumn("code", _code("context", "base"))
    _require(rows, (F.col("pos") < F.col("length")) & (F.col("pos") >= 0) & F.col("code").isNotNull(), "a place or context is wrong")
    _in_order(rows, "ci", "pos", "levels")
    _require(rows, F.col("dinuc").isin("CA", "CC", "CG", "CT") & ((F.col("dinuc") == "CG") == (F.col("context") == "CG")), "a dinucleotide contradicts its context")
    _require(rows, _unsigned("mc") <= _unsigned("nc"), "more methylated than all reads")
    level = F.when(F.col("level") != "na", F.expr("try_cast(level AS double)"))
    _require(rows, (F.col("level") == "na") | level.between(0, 1), "a level is outside 0..1")
    return rows.select("ci", "pos", "code", level.alias("level"))


def bed_methyl(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, pos, strand, level): 11 or 18 fields, not mixed; the percentage becomes a level."""
    rows = _lines(spark, path).select("_at", F.split("value", "\t").alias("f"))
    _require(rows, F.size("f").isin(11, 18), "not 11 or 18 fields")
    _require(rows.agg(F.count_distinct(F.size("f")).alias("widths")), F.col("widths") <= 1, "widths are mixed")
    counts = F.filter(F.transform(F.slice("f", 12, 7), lambda x: F.when(x.rlike("^(0|[1-9][0-9]{0,9})$"), x.cast("long"))), lambda x: x.isNotNull())
    rows = rows.select("_at", F.size("f").alias("width"), counts.alias("counts"), *[F.col("f")[i].alias(n) for i, n in enumerate(["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "coverage", "percent"])])
    rows = _indexed(rows, contigs, "chrom", "levels")
    _require(rows, (F.col("name") != "") & _unsigned("score").isNotNull() & _unsigned("coverage").isNotNull(), "a name, score or coverage is wrong")
    triple = F.split("rgb", ",")
    good = F.col("rgb").rlike("^(0|[0-9]{1,3},[0-9]{1,3},[0-9]{1,3})$") & F.forall(triple, lambda x: F.expr("true") & (x.try_cast("int") <= 255))
    _require(rows, good, "a colour is wrong")
    # Modified, canonical and other modified reads make up the coverage of the long form.
    _require(rows, (F.col("width") == 11) | (F.size("counts") == 7) & (F.aggregate(F.slice("counts", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x) == _unsigned("coverage")), "counts do not add up to the coverage")
    rows = rows.withColumn("at_", _unsigned("start"))
    _in_order(rows, "ci", "at_", "levels")
    _require(rows, (F.col("thick_start") == F.col("start")) & (F.col("thick_end") == F.col("end")) & (_unsigned("end") == _unsigned("start") + 1), "not one base, or thick bounds differ")
    _require(rows, F.col("strand").isin("+", "-", ".") & F.expr("try_cast(percent AS double)").between(0, 100), "a strand or percentage is wrong")
    return rows.select("ci", _unsigned("start").alias("pos"), "strand", F.when(_unsigned("coverage") > 0, F.col("percent").cast("double") / 100).alias("level"))


def asm(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, pos, code, snp_pos, ref, alt, ref_level, alt_level) of the fourteen-field table."""
    names = ["chrom", "base", "pos", "context", "dinuc", "level", "snp", "ref", "alt", "ref_level", "alt_level", "fold", "p", "comment"]
    rows = _indexed(_fields(_lines(spark, path), names, "allele levels"), contigs, "chrom", "allele levels").withColumn("code", _code("context", "base"))
    _require(rows, F.col("code").isNotNull() & F.col("ref").rlike("^[ACGT]$") & F.col("alt").rlike("^[ACGT]$"), "a context or allele is wrong")
    level = lambda c: F.expr(f"try_cast({c} AS double)")
    _require(rows, level("ref_level").between(0, 1) & level("alt_level").between(0, 1), "a level is outside 0..1")
    return rows.select("ci", (_unsigned("pos") - 1).alias("pos"), "code", (_unsigned("snp") - 1).alias("snp_pos"), "ref", "alt", level("ref_level").alias("ref_level"), level("alt_level").alias("alt_level"))


def asm_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, pos, strand, snp_pos, ref, alt, ref_level, alt_level) of the twelve-field form."""
    names = ["chrom", "start", "end", "name", "score", "strand", "linked_start", "linked_end", "ref", "alt", "ref_level", "alt_level"]
    rows = _indexed(_fields(_lines(spark, path), names, "allele levels"), contigs, "chrom", "allele levels")
    _require(rows, (_unsigned("end") == _unsigned("start") + 1) & (_unsigned("linked_end") == _unsigned("linked_start") + 1) & F.col("strand").isin("+", "-", "."), "not one base, or a wrong strand")
    level = lambda c: F.expr(f"try_cast({c} AS double)")
    _require(rows, level("ref_level").between(0, 1) & level("alt_level").between(0, 1) & _unsigned("score").between(0, 1000), "a level or score is out of range")
    return rows.select("ci", _unsigned("start").alias("pos"), "strand", _unsigned("linked_start").alias("snp_pos"), "ref", "alt", level("ref_level").alias("ref_level"), level("alt_level").alias("alt_level"))


def targets(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(ci, st, en, name, score, strand) of a six-field BED; no interval and strand twice."""
    rows = _indexed(_fields(_lines(spark, path), ["chrom", "start", "end", "name", "score", "strand"], "targets"), contigs, "chrom", "targets")
    rows = rows.withColumn("st", _unsigned("start")).withColumn("en", _unsigned("end"))
    _require(rows, (F.col("st") < F.col("en")) & (F.col("en") <= F.col("length")) & F.col("strand").isin("+", "-", "."), "an interval or strand is wrong")
    _require(rows, F.expr("try_cast(score AS double)") >= 0, "a score is negative or no number")
    _require(rows.groupBy("ci", "st", "en", "strand").count(), F.col("count") == 1, "a target occurs twice")
    return rows.select("ci", "st", "en", "name", F.col("score").cast("double").alias("score"), "strand")


def candidates(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """The ten-column fragment catalogue; score null for '.'; ids are unique."""
    names = ["chrom", "start", "end", "candidate_id", "score", "strand", "haplotype_mask", "template_length", "gc_count", "restriction_site_count"]
    rows = _indexed(_fields(_lines(spark, path), names, "candidates"), contigs, "chrom", "candidates")
    score = F.when(F.col("score") != ".", F.expr("try_cast(score AS double)"))
    _require(rows, (F.col("score") == ".") | (score >= 0), "a score is negative or no number")
    _require(rows, _unsigned("haplotype_mask").between(1, 3) & (F.col("strand") == "."), "a mask or strand is wrong")
    _require(rows.groupBy("candidate_id").count(), F.col("count") == 1, "an id occurs twice")
    return rows.select("ci", "chrom", "candidate_id", score.alias("score"), *[_unsigned(c).alias(c) for c in ("start", "end", "haplotype_mask", "template_length", "gc_count", "restriction_site_count")])


def gc_profile(spark: SparkSession, path: str) -> DataFrame:
    """(bin, p): one share a line, two at least, in 0..1, summing to one."""
    lines = [r["value"] for r in spark.read.text(path).limit(100_001).collect()]
    try:
        shares = [float(x) for x in lines if x.strip()]
    except ValueError as e:
        raise FormatError(f"a share is no number: {e}") from None
    if not 2 <= len(shares) <= 100_000 or not all(0 <= p <= 1 for p in shares) or abs(sum(shares) - 1) > 1e-9:
        raise FormatError("shares are not a distribution over 2 to 100,000 bins")
    return spark.createDataFrame(list(enumerate(shares)), "bin long, p double")


def _document(spark: SparkSession, path: str) -> dict:
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    if len(raw) > MODEL_BYTES:
        raise FormatError("the model is larger than 8 MiB")

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise FormatError("a key occurs twice")
        return dict(pairs)

    def never(x):
        raise FormatError(f"not a finite number: {x}")

    return json.loads(raw.decode("utf-8"), object_pairs_hook=once, parse_constant=never)


def count_model(spark: SparkSession, path: str, schema: str) -> dict:
    """A quality chain or confusion model of counts, checked for shape and positive rows."""
    doc = _document(spark, path)
    if set(doc) != {"schema", "quality_scores", "mates"} or doc["schema"] != schema or len(doc["mates"]) != 2:
        raise FormatError("unknown fields or schema")
    scores = doc["quality_scores"]
    if not scores or any(type(q) is not int or not 0 <= q <= 93 for q in scores) or sorted(set(scores)) != scores:
        raise FormatError("quality scores do not increase within 0..93")
    n = len(scores)
    shapes = {"quality-markov-v1": {"initial_counts": (5, n), "transition_counts": (n, n)}, "quality-confusion-v1": {"base_transition_counts": (n, 4, 4)}}[schema]
    for mate in doc["mates"]:
        if set(mate) != set(shapes):
            raise FormatError("unknown fields of a mate")
        for name, shape in shapes.items():
            _check_counts(mate[name], shape, name)
    return doc


def _check_counts(rows, shape: tuple[int, ...], name: str) -> None:
    if not isinstance(rows, list) or len(rows) != shape[0]:
        raise FormatError(f"{name} has a wrong shape")
    if len(shape) > 1:
        for r in rows:
            _check_counts(r, shape[1:], name)
    elif any(type(x) is not int or not 0 <= x < 2**32 for x in rows) or not sum(rows):
        raise FormatError(f"{name} has a bad count or an empty row")


def digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file's bytes, in a task; the bytes do not reach the driver."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.sha2("content", 256).alias("d")).first()["d"]


#: Characters of a line that a profile may have.
LONGEST_LINE = 1 << 20


def verified_lines(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(value): the lines of a file whose bytes have the given digest, before the lines are looked at and after.

    The lines are written once to the shared folder in between, so that what is used later is what was verified.
    """
    from ..operators.lineage import kept

    if digest(spark, path) != sha256.lower():
        raise FormatError(f"{path} has another digest")
    rows = kept(_lines(spark, path, "^$").select("value"))
    _require(rows.select(F.length("value").alias("length")), F.col("length") <= LONGEST_LINE, "a line is too long")
    if digest(spark, path) != sha256.lower():
        raise FormatError(f"{path} changed while it was read")
    return rows


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
