"""End to end: readers, a simulation, its outputs, and the same run as a stream."""

import hashlib
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandlake.plans import reads, run
from strandlake.sources import readers, sinks
from strandlake.streaming import ordinals

FASTA = ">chrA one\nACGTACGTCCGGACGTACGTTGCA\nGGCCATCGATCGACCGGTTACGCA\n>chrB\nTTTTCGCGAACCGGTTGCATCGAT\n"


@pytest.fixture
def contigs(spark, tmp_path):
    (tmp_path / "x.fa").write_text(FASTA)
    return readers.fasta(spark, str(tmp_path / "x.fa"))


def _plain(contigs):
    return contigs.select(F.col("contig_index").cast("long").alias("ci"), "name", "seq", F.col("length").alias("len"))


def test_fasta(contigs, spark, tmp_path):
    rows = contigs.orderBy("contig_index").collect()
    assert [(r["contig_index"], r["name"], r["length"]) for r in rows] == [(0, "chrA", 48), (1, "chrB", 24)]
    (tmp_path / "odd.fa").write_text(">a x>y >z\r\nac\r\nGT\r\n>b\nNN\n")
    assert sorted((r["name"], r["seq"]) for r in readers.fasta(spark, str(tmp_path / "odd.fa")).collect()) == [("a", "ACGT"), ("b", "NN")]
    for bad in (">a\nACGU\n", "ACGT\n>a\nAC\n", ">a\n>b\nAC\n", ">a\nA\n>a\nC\n"):
        (tmp_path / "bad.fa").write_text(bad)
        with pytest.raises(readers.FormatError):
            readers.fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_unsigned_numbers():
    assert readers.u64("0") == 0 and readers.u64(str(2**64 - 1)) == 2**64 - 1
    for bad in ("", "-1", "+1", "01", " 1", str(2**64), "1e3", "١"):
        with pytest.raises(readers.FormatError):
            readers.u64(bad)


def test_variant_calls(contigs, spark, tmp_path):
    head = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    (tmp_path / "x.vcf").write_text(head + "chrA\t2\t.\tC\tT\t.\t.\t.\tGT\t0|1\nchrA\t5\t.\tA\tAGG\t.\t.\t.\tGT:DP\t1/1:9\nchrB\t7\t.\tG\tA\t.\t.\t.\tGT\t0/0\nchrB\t9\t.\tA\tC\t.\t.\t.\tGT\t1/0\n")
    got = readers.vcf(spark, str(tmp_path / "x.vcf"), contigs).orderBy("ci", "pos").collect()
    assert [(r["ci"], r["pos"], r["phased"], r["mask"]) for r in got] == [(0, 1, True, 2), (0, 4, False, 3), (1, 8, False, None)]
    (tmp_path / "y.vcf").write_text(head + "chrZ\t2\t.\tC\tT\t.\t.\t.\tGT\t0|1\n")
    with pytest.raises(readers.FormatError):
        readers.vcf(spark, str(tmp_path / "y.vcf"), contigs)


VCF = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def test_rows_out_of_order_are_refused(contigs, spark, tmp_path):
    call = lambda c, p, i=".": f"{c}\t{p}\t{i}\tC\tT\t.\t.\t.\tGT\t0|1\n"
    site = lambda c, p, dinuc="CG": f"{c}\tC\t{p}\tCG\t{dinuc}\t0.25\t1\t4\n"
    for k, rows in enumerate(([("chrA", 9), ("chrA", 2)], [("chrA", 2), ("chrA", 2)], [("chrB", 1), ("chrA", 2)], [("chrA", 2), ("chrB", 1), ("chrA", 5)])):
        (tmp_path / f"{k}.vcf").write_text(VCF + "".join(call(*r) for r in rows))
        (tmp_path / f"{k}.cg").write_text("".join(site(*r) for r in rows))
        with pytest.raises(readers.FormatError, match="order"):
            readers.vcf(spark, str(tmp_path / f"{k}.vcf"), contigs)
        with pytest.raises(readers.FormatError, match="order"):
            readers.cgmap(spark, str(tmp_path / f"{k}.cg"), contigs)
    (tmp_path / "d.cg").write_text(site("chrA", 2, "TT"))
    with pytest.raises(readers.FormatError, match="dinucleotide"):
        readers.cgmap(spark, str(tmp_path / "d.cg"), contigs)
    rows = [("chrA", p) for p in range(1, 40)] + [("chrB", p) for p in range(1, 20)]
    (tmp_path / "long.cg").write_text("".join(site(*r) for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert readers.cgmap(spark, str(tmp_path / "long.cg"), contigs).count() == 58
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_variant_ids_are_unique(contigs, spark, tmp_path):
    call = lambda c, p, i: f"{c}\t{p}\t{i}\tC\tT\t.\t.\t.\tGT\t0|1\n"
    (tmp_path / "i.vcf").write_text(VCF + call("chrA", 2, ".") + call("chrA", 6, "rs1") + call("chrB", 1, "rs1") + call("chrB", 5, "."))
    got = readers.vcf(spark, str(tmp_path / "i.vcf"), contigs).orderBy("ci", "pos").collect()
    assert [r["id"] for r in got] == ["vcf_0", "rs1", "rs1@100000000", "vcf_100000001"]


def test_modified_bases_and_allele_levels(contigs, spark, tmp_path):
    row = "chrA\t{0}\t{1}\tm\t9\t{2}\t{0}\t{1}\t{3}\t4\t{4}"
    (tmp_path / "a.bed").write_text("track t\n" + row.format(1, 2, "+", "0", "25") + "\n" + row.format(2, 3, "-", "255,0,9", "100.0") + "\n")
    assert [tuple(r) for r in readers.bed_methyl(spark, str(tmp_path / "a.bed"), contigs).orderBy("pos").collect()] == [(0, 1, "+", 0.25), (0, 2, "-", 1.0)]
    (tmp_path / "b.bed").write_text(row.format(1, 2, "+", "0", "25") + "\t1\t2\t1\t7\t0\t0\t0\n")
    assert readers.bed_methyl(spark, str(tmp_path / "b.bed"), contigs).count() == 1
    bad = [row.format(1, 2, "+", "256,0,0", "25"), row.format(1, 3, "+", "0", "25"), row.format(1, 2, "*", "0", "25"), row.format(1, 2, "+", "0", "101"), row.format(1, 2, "+", "0", "25") + "\t1\t1\t1\t7\t0\t0\t0", row.format(2, 3, "+", "0", "25") + "\n" + row.format(1, 2, "+", "0", "25")]
    for text in bad:
        (tmp_path / "c.bed").write_text(text + "\n")
        with pytest.raises(readers.FormatError):
            readers.bed_methyl(spark, str(tmp_path / "c.bed"), contigs)
    (tmp_path / "x.asm").write_text("chrA\tC\t2\tCG\tCG\t0.5\t5\tA\tG\t0.1\t0.9\t2.0\t0.01\tc\n")
    assert [tuple(r) for r in readers.asm(spark, str(tmp_path / "x.asm"), contigs).collect()] == [(0, 1, 1, 4, "A", "G", 0.1, 0.9)]
    (tmp_path / "y.asm").write_text("chrA\tC\t2\tCG\tCG\t0.5\t5\tA\tGG\t0.1\t0.9\t2.0\t0.01\tc\n")
    with pytest.raises(readers.FormatError):
        readers.asm(spark, str(tmp_path / "y.asm"), contigs)
    (tmp_path / "z.bed").write_text("chrA\t1\t2\tn\t900\t+\t4\t5\tA\tG\t0.1\t0.9\n")
    assert [tuple(r) for r in readers.asm_bed(spark, str(tmp_path / "z.bed"), contigs).collect()] == [(0, 1, "+", 4, "A", "G", 0.1, 0.9)]
    (tmp_path / "z2.bed").write_text("chrA\t1\t2\tn\t1001\t+\t4\t5\tA\tG\t0.1\t0.9\n")
    with pytest.raises(readers.FormatError):
        readers.asm_bed(spark, str(tmp_path / "z2.bed"), contigs)


def test_fragment_catalogue_round_trip(contigs, spark, tmp_path):
    columns = ["chrom", "start", "end", "candidate_id", "score", "strand", "haplotype_mask", "template_length", "gc_count", "restriction_site_count"]
    c = _plain(contigs)
    rows = run.rrbs_catalog(c, [("CG", 1)]).join(c.select("ci", "name"), "ci")
    rows = rows.select(F.col("name").alias("chrom"), F.col("left").alias("start"), F.col("right").alias("end"), F.concat_ws(":", "name", "left", "right").alias("candidate_id"), F.lit(None).cast("double").alias("score"), F.lit(".").alias("strand"), F.col("mask").alias("haplotype_mask"), (F.col("right") - F.col("left")).alias("template_length"), F.col("gc").alias("gc_count"), F.col("sites").alias("restriction_site_count"))
    given = spark.createDataFrame([("chrA", 1, 45, "a", 2.0, ".", 3, 44, 20, 2), ("chrB", 0, 20, "b", None, ".", 1, 20, 9, 2)], rows.schema)
    sinks.bed_lines(given, columns).select("line").coalesce(1).write.text(str(tmp_path / "bed"))
    got = readers.candidates(spark, str(tmp_path / "bed"), contigs).orderBy("start").collect()
    assert [(r["ci"], r["candidate_id"], r["score"], r["start"], r["haplotype_mask"]) for r in got] == [(1, "b", None, 0, 1), (0, "a", 2.0, 1, 3)]


def test_verified_lines(spark, tmp_path, monkeypatch):
    path = tmp_path / "p.txt"
    path.write_text("a\tb\n\nc\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert sorted(r["value"] for r in readers.verified_lines(spark, str(path), digest.upper()).collect()) == ["a\tb", "c"]
    with pytest.raises(readers.FormatError, match="another digest"):
        readers.verified_lines(spark, str(path), "0" * 64)
    monkeypatch.setattr(readers, "LONGEST_LINE", 2)
    with pytest.raises(readers.FormatError, match="too long"):
        readers.verified_lines(spark, str(path), digest)
    monkeypatch.undo()
    seen = iter([digest, "1" * 64])
    monkeypatch.setattr(readers, "digest", lambda *_: next(seen))
    with pytest.raises(readers.FormatError, match="changed"):
        readers.verified_lines(spark, str(path), digest)


def test_saved_catalogue_is_bound(contigs, spark, tmp_path):
    c = _plain(contigs)
    catalog = run.methylation_catalog(c, 5)
    run.save_catalog(str(tmp_path / "db"), catalog, run.binding(c, 5))
    back = run.load_catalog(spark, str(tmp_path / "db"), run.binding(c, 5))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, catalog.collect()))
    with pytest.raises(run.ConfigError):
        run.load_catalog(spark, str(tmp_path / "db"), run.binding(c, 6))


def test_levels_and_targets(contigs, spark, tmp_path):
    (tmp_path / "x.cg").write_text("chrA\tC\t2\tCG\tCG\t0.25\t1\t4\nchrA\tG\t3\tCG\tCG\tna\t0\t0\n")
    assert [tuple(r) for r in readers.cgmap(spark, str(tmp_path / "x.cg"), contigs).orderBy("pos").collect()] == [(0, 1, 1, 0.25), (0, 2, 9, None)]
    (tmp_path / "x.bed").write_text("track x\nchrA\t1\t9\tt\t3\t+\nchrB\t0\t4\tu\t1.5\t.\n")
    assert [tuple(r) for r in readers.targets(spark, str(tmp_path / "x.bed"), contigs).orderBy("ci").collect()] == [(0, 1, 9, "t", 3.0, "+"), (1, 0, 4, "u", 1.5, ".")]
    (tmp_path / "gc.tsv").write_text("0.25\n0.5\n0.25\n")
    assert readers.gc_profile(spark, str(tmp_path / "gc.tsv")).count() == 3
    (tmp_path / "gc2.tsv").write_text("0.25\n0.5\n")
    with pytest.raises(readers.FormatError):
        readers.gc_profile(spark, str(tmp_path / "gc2.tsv"))


def test_count_models(spark, tmp_path):
    doc = {"schema": "quality-markov-v1", "quality_scores": [10], "mates": [{"initial_counts": [[1]] * 5, "transition_counts": [[1]]}] * 2}
    (tmp_path / "q.json").write_text(json.dumps(doc))
    assert readers.count_model(spark, str(tmp_path / "q.json"), "quality-markov-v1")["quality_scores"] == [10]
    for broken in (doc | {"extra": 1}, doc | {"quality_scores": [10, 9]}, doc | {"mates": doc["mates"][:1]}):
        (tmp_path / "b.json").write_text(json.dumps(broken))
        with pytest.raises(readers.FormatError):
            readers.count_model(spark, str(tmp_path / "b.json"), "quality-markov-v1")


CONFIG = run.RunConfig(fragments=60, read_length=5, insert=12, seed=9)


def _whole(sim, contigs):
    """(read row, template) of every fragment of a run on the reference."""
    seqs = {r["ci"]: r["seq"] for r in contigs.collect()}
    return [(r, seqs[r["ci"]][r["start"] : r["start"] + r["span"]]) for r in sim.reads.collect()]


RC = str.maketrans("ACGTN", "TGCAN")


def test_extremes(spark, contigs):
    c = _plain(contigs)
    sim = run.simulate(spark, c, config=run.RunConfig(fragments=40, read_length=5, insert=12, conversion_rate=0, error_rate=0))
    rows = _whole(sim, c)
    assert len(rows) == 40
    for r, t in rows:
        assert r["mate1"] == t[:5] and r["mate2"] == t[::-1].translate(RC)[:5] and r["mode"] == 0 and r["cigar1"] == "5M"
    wrong = run.simulate(spark, c, config=run.RunConfig(fragments=40, read_length=5, insert=12, conversion_rate=0, error_rate=1))
    assert all(a != b for r, t in _whole(wrong, c) for a, b in zip(r["mate1"], t[:5], strict=True))
    both = run.simulate(spark, c, config=run.RunConfig(fragments=40, read_length=5, insert=12, directional=False))
    assert {r["mode"] for r in both.reads.collect()} == {0, 1}
    one = run.simulate(spark, c, config=run.RunConfig(fragments=40, read_length=5, insert=12, paired=False))
    assert all(r["mate2"] is None and r["mate1"] for r in one.reads.collect()) and one.fastq().count() == 40
    lines = [r["line"].split("\t") for r in one.sam().collect()]
    assert {x[1] for x in lines} == {"0"} and {tuple(x[6:9]) for x in lines} == {("*", "0", "0")}


def test_depth_and_profiles(spark, contigs):
    c = _plain(contigs)
    shape = dict(read_length=5, insert=12, depth=3.0)
    assert run.simulate(spark, c, config=run.RunConfig(**shape)).reads.count() == -(-72 * 3 // 10)
    assert run.simulate(spark, c, config=run.RunConfig(**shape, paired=False)).reads.count() == -(-72 * 3 // 5)
    # All mass on windows of which at most a third are G or C: few contigs, few starts.
    low = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.0)], "bin long, p double")
    poor = spark.createDataFrame([(0, "a", "AATT" * 20, 80), (1, "b", "GGCC" * 20, 80)], "ci long, name string, seq string, len long")
    for extra in ({}, {"insert_min": 8, "insert_max": 16, "insert_stddev": 2.0}):
        rows = run.simulate(spark, poor, config=run.RunConfig(**shape, **extra), inputs=run.Inputs(gc_profile=low)).reads.collect()
        assert len(rows) == 24 and {r["ci"] for r in rows} == {0}
        assert extra == {} or len({r["span"] for r in rows}) > 3
    events = spark.createDataFrame([(0, 10, 11, "C", 1)], "ci long, ref_start long, ref_end long, alt_bases string, mask int")
    rows = run.simulate(spark, poor, config=run.RunConfig(**shape), inputs=run.Inputs(gc_profile=low, events=events)).reads.collect()
    assert len(rows) == 48 and {r["ci"] for r in rows} == {0} and {r["haplotype"] for r in rows} == {0, 1}


MODEL = {"quality_scores": [10, 30], "mates": [{"initial_counts": [[1, 0]] * 5, "transition_counts": [[0, 1], [0, 1]]}, {"initial_counts": [[0, 1]] * 5, "transition_counts": [[1, 0], [1, 0]]}]}
SWAP = {"quality_scores": [10, 30], "mates": [{"base_transition_counts": [[[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]]}] * 2}


def test_models_apply_after_conversion(spark, contigs):
    c = _plain(contigs)
    config = run.RunConfig(fragments=30, read_length=7, insert=12, conversion_rate=1.0)
    plain = {r["ordinal"]: r for r in run.simulate(spark, c, config=config, inputs=run.Inputs(levels=None, quality=MODEL, confusion={**SWAP, "mates": [{"base_transition_counts": [[[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]] * 2}] * 2})).reads.collect()}
    swapped = run.simulate(spark, c, config=config, inputs=run.Inputs(quality=MODEL, confusion=SWAP)).reads.collect()
    for r in swapped:
        # The first five cycles of mate 1 and the last two of mate 2 have the quality that swaps A with C and G with T.
        assert r["qual1"] == "+" * 5 + "??" and r["qual2"] == "?" * 5 + "++"
        for mate, low in ((1, slice(0, 5)), (2, slice(5, 7))):
            before, after = plain[r["ordinal"]][f"mate{mate}"], r[f"mate{mate}"]
            assert after[low] == before[low].translate(str.maketrans("ACGT", "CATG"))
            assert after[:5] + after[5:] == "".join(a if (k < 5) == (mate == 1) else b for k, (a, b) in enumerate(zip(after, before, strict=True)))
        assert plain[r["ordinal"]]["mate1"].count("C") == sum(1 for k, x in enumerate(plain[r["ordinal"]]["converted"][:7]) if x == "C")


def test_restriction_and_target_runs(spark, contigs, tmp_path):
    c = _plain(contigs)
    seqs = {r["ci"]: r["seq"] for r in c.collect()}
    rrbs = run.RunConfig(fragments=50, technology="RRBS", read_length=4, insert_min=8, insert_max=30, cut_sites=("C|CGG", "C|G"))
    cuts = {ci: sorted({k + 1 for k in range(len(s)) if s.startswith("CCGG", k) or s.startswith("CG", k)}) for ci, s in seqs.items()}
    rows = run.simulate(spark, c, config=rrbs).reads.collect()
    assert len({r["ordinal"] for r in rows}) == 50
    assert all(r["start"] in cuts[r["ci"]] and r["start"] + r["span"] in cuts[r["ci"]] and 8 <= r["span"] <= 30 for r in rows)
    fragments = [(ci, a, b, 3.0 * (k == 2)) for k, (ci, a, b) in enumerate((ci, a, b) for ci, x in cuts.items() for a in x for b in x if 8 <= b - a <= 30)]
    scores = spark.createDataFrame(fragments, "ci long, left long, right long, score double")
    scored = run.simulate(spark, c, config=replace(rrbs, by_score=True), inputs=run.Inputs(scores=scores)).reads.collect()
    assert {(r["ci"], r["start"], r["start"] + r["span"]) for r in scored} == {fragments[2][:3]}
    targets = spark.createDataFrame([(0, 14, 18, "+", 3.0), (0, 30, 34, "-", 1.0), (0, 22, 26, ".", 0.0)], "ci long, st long, en long, strand string, score double")
    tbs = run.RunConfig(fragments=60, technology="TBS", read_length=4, insert=12, center_stddev=0.0, by_score=True)
    rows = run.simulate(spark, c, config=tbs, inputs=run.Inputs(targets=targets)).reads.collect()
    assert {(r["start"], r["mode"]) for r in rows} == {(10, 0), (26, 1)} and len(rows) == 60
    moved = run.simulate(spark, c, config=replace(tbs, center_stddev=3.0), inputs=run.Inputs(targets=targets)).reads.collect()
    assert len(moved) == 60 and len({r["start"] for r in moved}) > 4
    with pytest.raises(run.ConfigError):
        run.simulate(spark, c, config=tbs)


def _cigar(origins):
    ops, last = [], None
    for x in origins:
        if x >= 0 and last is not None and x > last + 1:
            ops.append(("D", x - last - 1))
        if ops and ops[-1][0] == ("M" if x >= 0 else "I"):
            ops[-1] = ops[-1][0], ops[-1][1] + 1
        else:
            ops.append(("M" if x >= 0 else "I", 1))
        last = x if x >= 0 else last
    return "".join(f"{n}{op}" for op, n in ops)


@pytest.mark.parametrize("variable", [False, True])
def test_reads_with_variants_align(spark, variable):
    import random

    from test_operators import _haplotype

    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    events = [(20, 21, "G" if seq[20] != "G" else "T", 3), (40, 40, "ACCGT", 1), (70, 74, "", 2), (100, 100, "TTTTTTTTT", 3), (130, 131, "A" if seq[130] != "A" else "C", 2), (200, 206, "", 3), (260, 260, "C", 2)]
    c = spark.createDataFrame([(0, "c", seq, len(seq))], "ci long, name string, seq string, len long")
    table = spark.createDataFrame([(0, *e) for e in events], "ci long, ref_start long, ref_end long, alt_bases string, mask int")
    config = run.RunConfig(fragments=300, read_length=9, insert=30, conversion_rate=0, error_rate=0, **({"insert_min": 20, "insert_max": 40, "insert_stddev": 6.0} if variable else {}))
    sim = run.simulate(spark, c, config=config, inputs=run.Inputs(events=table))
    rows = sim.reads.collect()
    lines = {(r["ordinal"], r["mate"]): r["line"].split("\t") for r in sim.sam(summary=True, realization=True).collect()}
    assert len(rows) == 300 and {r["haplotype"] for r in rows} == {0, 1}
    haps = [_haplotype(seq, events, h) for h in (0, 1)]
    for r in rows:
        bases, place, origin, places = haps[r["haplotype"]]
        a, b = place[r["start"]], place[r["start"] + r["span"]]
        assert r["converted"] == bases[a:b] and r["mate1"] == bases[a : a + 9] and r["mate2"] == bases[b - 9 : b][::-1].translate(RC)
        for mate, (x, y) in enumerate(((a, a + 9), (b - 9, b))):
            line = lines[r["ordinal"], mate]
            assert line[1] == ("99", "147")[mate] and line[5] == _cigar(origin[x:y]) and line[9] == bases[x:y]
            mapped = [o for o in origin[x:y] if o >= 0]
            if mapped:
                assert int(line[3]) == mapped[0] + 1
            n = sum((x < p < y) if p == q else max(p, x) < min(q, y) for p, q in places)
            assert r[f"summary{mate + 1}"][9] == n and r[f"summary{mate + 1}"][0] & 3 == r["haplotype"] + 1 and (r[f"summary{mate + 1}"][0] >> 4 & 1) == mate
            state = r["state"].split(",")[mate]
            covered = [any(p <= k < q for p, q in places) for k in range(x, y)]
            assert [reads.sq.STATE64.index(s) >> 4 & 1 for s in state] == list(map(int, covered))
        spans = [(int(lines[r["ordinal"], m][3]), lines[r["ordinal"], m][8]) for m in (0, 1)]
        assert int(spans[0][1]) == -int(spans[1][1])
        assert any(t.startswith("zf:B:S,") for t in lines[r["ordinal"], 0]) and any(t.startswith("zx:Z:") for t in lines[r["ordinal"], 0])


def test_levels_of_one_haplotype(spark):
    c = spark.createDataFrame([(0, "c", "ACGT" * 20, 80)], "ci long, name string, seq string, len long")
    none = spark.createDataFrame([(0, 2, 2, "", 3)], "ci long, ref_start long, ref_end long, alt_bases string, mask int").limit(0)
    levels = spark.createDataFrame([(0, 4 * k + 1, 1, 0.0, None) for k in range(20)] + [(0, 4 * k + 1, 1, 1.0, 1) for k in range(20)], "ci long, pos long, code int, level double, hap int")
    sim = run.simulate(spark, c, config=run.RunConfig(fragments=60, read_length=8, insert=16, conversion_rate=1.0, error_rate=0), inputs=run.Inputs(levels=levels, events=none))
    for r in sim.reads.collect():
        assert ("C" in r["converted"]) == (r["haplotype"] == 1)
        assert r["whole"][0] >> 7 & 1 == r["haplotype"]


def test_config():
    for bad in (dict(fragments=1, depth=1.0), dict(), dict(fragments=1, read_length=9, insert=8), dict(fragments=1, error_rate=2.0), dict(fragments=1, seed=-1), dict(fragments=1, technology="X"), dict(fragments=1, technology="RRBS"), dict(fragments=1, insert_min=1), dict(fragments=1, insert_min=500, insert_max=600)):
        with pytest.raises(run.ConfigError):
            run.RunConfig(**bad).checked()
    assert run.parse_cut("C|CGG") == ("CCGG", 1)
    with pytest.raises(run.ConfigError):
        run.parse_cut("CCGG")


def test_outputs_and_manifest(spark, contigs, tmp_path):
    sim = run.simulate(spark, _plain(contigs), config=CONFIG)
    with pytest.warns(UserWarning):
        run.simulate(spark, _plain(contigs), config=run.RunConfig(fragments=1, read_length=5, insert=12, state_model="other"))
    manifest = sim.write(str(tmp_path / "out"))
    part = manifest["outputs"]["mate1"]
    written = sorted((tmp_path / "out/mate1").glob("part-*"))
    assert part["rows"] == 60 and part["files"]["count"] == len(written) and part["files"]["bytes"] == sum(f.stat().st_size for f in written)
    assert part["files"]["sha256"] == hashlib.sha256("".join(hashlib.sha256(f.read_bytes()).hexdigest() for f in written).encode()).hexdigest()
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out/mate1")).collect()]
    assert len(lines) == 240 and len({x for x in lines[::4]}) == 60
    assert json.loads(spark.read.text(str(tmp_path / "out/manifest")).first()["value"]) == manifest
    with pytest.raises(sinks.OutputExists):
        sim.write(str(tmp_path / "out"))
    sim.write(str(tmp_path / "sam"), alignments=True)
    rows = [r["value"].split("\t") for r in spark.read.text(str(tmp_path / "sam/alignments/part*")).collect()]
    assert len(rows) == 120 and {r[1] for r in rows} == {"99", "147"} and all(len(r[9]) == 5 for r in rows)


def test_stream_equals_batch(spark, contigs, tmp_path):
    sim = run.simulate(spark, _plain(contigs), config=CONFIG)
    ordinals.split_ranges(spark, 60, 7).repartition(4).write.parquet(str(tmp_path / "ranges"))

    query = ordinals.run(spark, str(tmp_path / "ranges"), sim.of, str(tmp_path / "rows"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "rows")).drop("batch")
    assert sorted(map(str, got.select(*sim.reads.columns).collect())) == sorted(map(str, sim.reads.collect()))


def test_binding(spark, contigs):
    c = _plain(contigs)
    assert run.binding(c, 1) == run.binding(c.repartition(3), 1) != run.binding(c, 2)
    assert run.binding(c, 1, variants="x") != run.binding(c, 1, mutation=(0.1,))
    with pytest.raises(run.ConfigError):
        run.binding(c, 1, "x", (0.1,))
