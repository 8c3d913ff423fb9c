"""The public entry points: a checked configuration, and the three things that can be built from it."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, replace
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as sq
from ..operators import relops
from ..operators.lineage import kept
from ..sources import sinks
from ..sources.readers import digest_of
from . import diploid, haplotiles, libraries, models, reads, tiles
from .basics import Params, calibrated_weights


class ConfigError(ValueError):
    """A configuration is out of range or contradicts itself."""


@runtime_checkable
class StateModel(Protocol):
    """What draws the methylation states of sites: a function of their addresses and levels, in numpy batches.

    ``states(seed, ci, ordinal, site_index, level)`` gives a flag for each site of a contig.
    """

    name: str

    def states(self, seed: int, ci: int, ordinal: np.ndarray, site_index: np.ndarray, level: np.ndarray) -> np.ndarray: ...


class Bernoulli:
    """Independent coins at each site's level."""

    name = "bernoulli"

    def states(self, seed: int, ci: int, ordinal: np.ndarray, site_index: np.ndarray, level: np.ndarray) -> np.ndarray:
        return reads.bernoulli_states(seed, ci, ordinal, site_index, level)


MODELS: dict[str, StateModel] = {"bernoulli": Bernoulli()}
TECHNOLOGIES = ("WGBS", "RRBS", "TBS")


@dataclass(frozen=True)
class RunConfig:
    """One run.  Exactly one of ``fragments`` and ``depth`` is set.

    ``insert`` is the fixed length of fragments, and of WGBS the mean where ``insert_min`` and ``insert_max`` are
    set as well; RRBS takes fragments from ``insert_min`` to ``insert_max``.
    """

    fragments: int | None = None
    depth: float | None = None
    technology: str = "WGBS"
    read_length: int = 100
    insert: int = 400
    insert_min: int | None = None
    insert_max: int | None = None
    insert_stddev: float = 25.0
    cut_sites: tuple[str, ...] = ()
    center_stddev: float = 50.0
    by_score: bool = False
    max_ambiguous_fraction: float = 0.05
    paired: bool = True
    directional: bool = True
    conversion_rate: float = 0.998
    error_rate: float = 0.005
    phred: int = 40
    seed: int = 0
    catalog_seed: int | None = None
    state_model: str = "bernoulli"

    @property
    def variable(self) -> bool:
        return self.technology == "WGBS" and self.insert_min is not None

    @property
    def sizes(self) -> tuple[int, int, int, float]:
        return self.insert_min, self.insert, self.insert_max, self.insert_stddev

    def checked(self) -> RunConfig:
        for name in ("max_ambiguous_fraction", "conversion_rate", "error_rate"):
            if not 0 <= getattr(self, name) <= 1:
                raise ConfigError(f"{name} is outside 0..1")
        if (self.fragments is None) == (self.depth is None):
            raise ConfigError("set exactly one of fragments and depth")
        if (self.fragments or 0) < 0 or (self.depth or 0) < 0:
            raise ConfigError("fragments and depth are not negative")
        if self.technology not in TECHNOLOGIES:
            raise ConfigError(f"no technology {self.technology!r}")
        if (self.insert_min is None) != (self.insert_max is None):
            raise ConfigError("set both of insert_min and insert_max, or none")
        if self.technology == "RRBS" and (self.insert_min is None or not self.cut_sites):
            raise ConfigError("RRBS needs cut sites and a band of lengths")
        if self.technology != "RRBS" and self.cut_sites:
            raise ConfigError("only RRBS has cut sites")
        if self.technology == "TBS" and self.insert_min is not None:
            raise ConfigError("TBS has one insert length")
        if self.technology == "WGBS" and self.by_score:
            raise ConfigError("WGBS has no scores")
        shortest = self.insert if self.insert_min is None else self.insert_min
        if self.insert_min is not None and not (self.insert_min <= self.insert_max and (self.technology == "RRBS" or self.insert_min <= self.insert <= self.insert_max)):
            raise ConfigError("insert lengths are out of order")
        if not 1 <= self.read_length <= shortest:
            raise ConfigError("a read is at least one base and no longer than the insert")
        if self.insert_stddev < 0 or self.center_stddev < 0:
            raise ConfigError("a standard deviation is not negative")
        if not 0 <= self.phred <= 93:
            raise ConfigError("phred is outside 0..93")
        if not 0 <= self.seed < 2**64 or not 0 <= (self.catalog_seed or 0) < 2**64:
            raise ConfigError("seeds are unsigned 64-bit numbers")
        for cut in self.cut_sites:
            parse_cut(cut)
        return replace(self, catalog_seed=self.seed if self.catalog_seed is None else self.catalog_seed)

    def canonical(self) -> str:
        """The same text for equal configurations."""
        return json.dumps(asdict(self.checked()), sort_keys=True, separators=(",", ":"))

    def params(self, total: int) -> Params:
        c = self.checked()
        return Params(c.seed, c.catalog_seed, c.read_length, c.insert, int(c.max_ambiguous_fraction * c.read_length), total, c.conversion_rate, c.error_rate, c.phred)


@dataclass(frozen=True)
class Inputs:
    """What a run reads beside its contigs; every part may be missing.

    levels: (ci, pos, code, level) over default levels, with ``hap`` where a level is one haplotype's; events:
    (ci, ref_start, ref_end, alt_bases, mask); targets: (ci, st, en, strand, score); scores: (ci, left, right, score) of
    restriction fragments; gc_profile: (bin, p); quality and confusion: count models.
    """

    levels: DataFrame | None = None
    events: DataFrame | None = None
    targets: DataFrame | None = None
    scores: DataFrame | None = None
    gc_profile: DataFrame | None = None
    quality: dict | None = None
    confusion: dict | None = None


@dataclass(frozen=True)
class Simulation:
    """What a run gives; every part is a lazy DataFrame.  ``picked``: (ordinal, ci, start, span, ...)."""

    config: RunConfig
    contigs: DataFrame
    picked: DataFrame
    inputs: Inputs
    params: Params
    options: reads.Options

    def of(self, ordinals: DataFrame | None = None, details: bool = True) -> DataFrame:
        """The reads of some ordinals, or of all: only the tiles that hold their fragments are looked at."""
        picked = self.picked if ordinals is None else self.picked.join(ordinals.select("ordinal"), "ordinal", "left_semi")
        tiled = reads.placed(self.contigs, picked, self.inputs.levels, self.config.insert_max or self.config.insert, self.inputs.events)
        return reads.sequence(tiled, self.params, replace(self.options, details=details))

    @property
    def reads(self) -> DataFrame:
        return self.of()

    def fastq(self) -> DataFrame:
        """(mate, ordinal, record)."""
        return reads.records(self.of(details=False))

    def sam(self, summary: bool = False, realization: bool = False) -> DataFrame:
        """(ordinal, mate, line): alignments of the mates, in reference orientation, by their projections.

        ``summary`` and ``realization`` add the whole fragment's counters (zf) and packed states (zx).
        """
        both, rows = self.config.paired, self.reads
        ident = sq.read_name(F.col("name"), F.col("start"), F.col("start") + F.col("span"), F.col("ordinal"))
        group = digest_of(self.config.canonical())[:32]
        states = F.split("state", ",")
        outer = F.greatest("stop1", "stop2") - F.least("place1", "place2")
        sign = F.when(F.col("place1") <= F.col("place2"), 1).otherwise(-1)
        lines = []
        for mate in (1, 2) if both else (1,):
            other, forward = 3 - mate, mate == 1
            flag = (1 + 2 + (64 + 32 if forward else 128 + 16)) if both else 0
            seq, qual = (F.col(f"mate{mate}"), F.col(f"qual{mate}")) if forward else (sq.reverse_complement(F.col(f"mate{mate}")), F.reverse(f"qual{mate}"))
            mate_fields = [F.lit("="), F.col(f"place{other}") + 1, outer * sign * (1 if forward else -1)] if both else [F.lit("*"), F.lit(0), F.lit(0)]
            tags = [F.lit(f"RG:Z:{group}"), F.concat(F.lit("AS:i:"), F.length(seq))] + ([F.lit(f"MQ:i:{MAPQ}"), F.concat(F.lit("MC:Z:"), F.col(f"cigar{other}"))] if both else [])
            tags += [F.concat(F.lit("zt:Z:"), states[mate - 1]), F.concat(F.lit("zr:B:S,"), F.array_join(F.col(f"summary{mate}").cast("array<string>"), ","))]
            if summary:
                tags.append(F.concat(F.lit("zf:B:S,"), F.array_join(F.col("whole").cast("array<string>"), ",")))
            if realization:
                tags.append(F.concat(F.lit("zx:Z:"), F.concat_ws(".", F.lower(F.hex("n_sites")), F.lower(F.hex("n_convertible")), "site_bits", "conversion_bits")))
            fields = [ident, F.lit(flag), F.col("name"), F.col(f"place{mate}") + 1, F.lit(MAPQ), F.col(f"cigar{mate}"), *mate_fields, seq, qual, *tags]
            lines.append(F.struct(F.lit(mate - 1).alias("mate"), F.concat_ws("\t", *[x.cast("string") for x in fields]).alias("line")))
        return rows.select("ordinal", F.explode(F.array(*lines)).alias("l")).select("ordinal", "l.mate", "l.line")

    def write(self, folder: str, alignments: bool = False, summary: bool = False, realization: bool = False) -> dict:
        """FASTQ of the mates, or alignments, then the manifest; returns the manifest."""
        spark = self.contigs.sparkSession
        with sinks.Session(spark, folder) as out:
            if alignments:
                names = [(r["name"], r["len"]) for r in self.contigs.orderBy("ci").select("name", "len").collect()]  # a header line each
                out.text("alignments", self.sam(summary, realization), "line", ["ordinal", "mate"], header=sinks.sam_header(names, digest_of(self.config.canonical())[:32], "strandlake"))
            else:
                rows = self.fastq()
                for mate in (1, 2) if self.config.paired else (1,):
                    out.text(f"mate{mate}", rows.where(F.col("mate") == mate), "record", ["ordinal"], lines=4)
            return out.commit({"config": json.loads(self.config.canonical()), "config_sha256": digest_of(self.config.canonical())})


#: Mapping quality of every alignment: a fixed value.
MAPQ = 60


def simulate(spark: SparkSession, contigs: DataFrame, levels: DataFrame | None = None, config: RunConfig | None = None, inputs: Inputs | None = None) -> Simulation:
    """Reads of ``contigs`` (ci, name, seq, len) by ``config`` and ``inputs``; ``levels`` is short for inputs of levels only."""
    config, inputs = (config or RunConfig(fragments=1000)).checked(), inputs or Inputs(levels=levels)
    model = MODELS.get(config.state_model)
    if model is None:
        warnings.warn(f"state model {config.state_model!r} is not available; bernoulli is used", stacklevel=2)
        model = MODELS["bernoulli"]
    if config.technology == "TBS" and inputs.targets is None:
        raise ConfigError("TBS needs targets")
    if inputs.gc_profile is not None and config.technology != "WGBS":
        raise ConfigError("a GC profile is for WGBS")
    if inputs.events is not None and config.technology != "WGBS":
        raise ConfigError("variants are only drawn on whole genomes here")
    p = config.params(config.fragments if config.fragments is not None else _total(contigs, config, inputs))
    longest = config.insert_max or config.insert
    picked = kept(_picks(contigs, config, inputs, p, longest))
    options = reads.Options(config.paired, config.directional, inputs.quality, inputs.confusion, model.states)
    return Simulation(config, contigs, picked, inputs, p, options)


def _total(contigs: DataFrame, config: RunConfig, inputs: Inputs) -> int:
    """Fragments for a depth over the contigs, or the union of the targets or restriction fragments, rounded up."""
    if config.technology == "WGBS":
        # Contigs that no fragment can come from do not count.
        p = config.params(0)
        longest = config.insert_max or p.insert
        if inputs.events is not None:
            able = haplotiles.counts(haplotiles.tiled(contigs, inputs.events, longest, diploid.CORE), p.read, longest, p.max_n).select("ci").distinct()
        elif inputs.gc_profile is not None:
            o, accept, _ = libraries.gc_domain(contigs, inputs.gc_profile, inputs.gc_profile.count(), p)
            able = calibrated_weights(o, accept, ["bin"]).where("mass > 0").select("ci")
        else:
            able = tiles.start_counts(contigs, p.read, longest, p.max_n).select("ci").distinct()
        bases = contigs.join(able, "ci", "left_semi").agg(F.sum("len")).first()[0]
    else:
        if config.technology == "TBS":
            spans = inputs.targets.select("ci", "st", "en")
        else:
            cuts = [parse_cut(c) for c in config.cut_sites]
            p = config.params(0)
            rows = libraries.candidates(contigs, libraries.candidate_pairs(tiles.cut_places(contigs, cuts), config.insert_min, config.insert_max), config.insert_max, p.read, p.max_n)
            spans = rows.select("ci", F.col("left").alias("st"), F.col("right").alias("en"))
        bases = relops.islands(spans.distinct(), ["ci"], "st", "en").agg(F.sum(F.col("en") - F.col("st"))).first()[0]
    return -int(-((bases or 0) * config.depth) // ((2 if config.paired else 1) * config.read_length))


def _picks(contigs: DataFrame, config: RunConfig, inputs: Inputs, p: Params, longest: int) -> DataFrame:
    """(ordinal, ci, start, span, ...) of the run's fragments."""
    if config.technology == "RRBS":
        scores = inputs.scores if config.by_score else None
        if config.by_score and scores is None:
            raise ConfigError("scores of restriction fragments are missing")
        return libraries.draw_rrbs(contigs, [parse_cut(c) for c in config.cut_sites], p, config.insert_min, config.insert_max, scores)
    if config.technology == "TBS":
        return libraries.draw_tbs(contigs, inputs.targets, p, config.center_stddev, config.by_score)
    bins = inputs.gc_profile.count() if inputs.gc_profile is not None else 0
    fixed = F.lit(p.insert).cast("long").alias("span")
    if inputs.events is None:
        if config.variable:
            return libraries.numbered(libraries.draw_variable(contigs, p, config.sizes, inputs.gc_profile, bins), "insert_length").select("ordinal", "ci", "start", "span")
        drawn = libraries.draw_gc(contigs, inputs.gc_profile, bins, p) if bins else libraries.draw_uniform(contigs, p)
        return drawn.select("ordinal", "ci", "start", fixed)
    tiled = haplotiles.tiled(contigs, inputs.events, longest, diploid.CORE)
    if config.variable:
        if bins:
            raise ConfigError("a GC profile on haplotypes needs a fixed insert")
        drawn = libraries.numbered(diploid.draw_variable(contigs, tiled, p, config.sizes), "span")
        return diploid.chosen(drawn, p.seed).select("ordinal", "ci", "start", "span", "haplotype")
    drawn = diploid.draw_gc(tiled, inputs.gc_profile, bins, p) if bins else diploid.draw_uniform(tiled, p)
    return drawn.select("ordinal", "ci", "start", fixed, "haplotype")


def rrbs_catalog(contigs: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """Restriction fragments between cuts in the length band."""
    return libraries.candidates(contigs, libraries.candidate_pairs(tiles.cut_places(contigs, cuts)))


def parse_cut(text: str) -> tuple[str, int]:
    """'C|CGG' as (motif, place of the cut)."""
    left, bar, right = text.partition("|")
    motif = left + right
    if not bar or "|" in right or not motif or set(motif) - set("ACGTN"):
        raise ConfigError(f"not a motif with one cut: {text!r}")
    return motif, len(left)


def methylation_catalog(contigs: DataFrame, catalog_seed: int) -> DataFrame:
    """(ci, pos, code, level): a Beta level for every site of every contig."""
    return models.beta_table(tiles.contexts(contigs), catalog_seed)


def binding(contigs: DataFrame, catalog_seed: int, variants: str | None = None, mutation: tuple[float, ...] | None = None) -> str:
    """The digest that ties a saved methylation catalogue to its inputs: the reference, the catalogue seed, and
    either the variant file's digest or the mutation parameters. Levels and shapes do not count."""
    if variants is not None and mutation is not None:
        raise ConfigError("a catalogue is bound to a variant file or to mutation parameters, not to both")
    names = [(r["name"], r["d"]) for r in contigs.orderBy("ci").select("name", F.sha2("seq", 256).alias("d")).collect()]  # a line a contig
    return digest_of(json.dumps({"contigs": names, "catalog_seed": catalog_seed, "variants": variants, "mutation": mutation}, sort_keys=True))


def save_catalog(folder: str, catalog: DataFrame, bound_to: str) -> dict:
    """Write a methylation catalogue (ci, pos, code, level) by contig, and the ``binding`` that it belongs to."""
    spark = catalog.sparkSession
    with sinks.Session(spark, folder) as out:
        out.parquet("levels", catalog.sortWithinPartitions("ci", "pos"), by="ci")
        return out.commit({"binding": bound_to})


def load_catalog(spark: SparkSession, folder: str, bound_to: str) -> DataFrame:
    """(ci, pos, code, level) of a saved catalogue; it must be bound to the same inputs, whole, and without repeats."""
    manifest = json.loads(spark.read.text(f"{folder.rstrip('/')}/manifest").first()["value"])
    if manifest.get("binding") != bound_to:
        raise ConfigError("the catalogue is bound to another reference, seed or variants")
    rows = spark.read.parquet(f"{folder.rstrip('/')}/levels").select(F.col("ci").cast("long").alias("ci"), "pos", "code", "level")
    if rows.count() != manifest["outputs"]["levels"]["rows"]:
        raise ConfigError("the catalogue is not whole")
    if not rows.groupBy("ci", "pos").count().where("count > 1").isEmpty():
        raise ConfigError("a site occurs twice in the catalogue")
    return rows
