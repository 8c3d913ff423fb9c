"""Relational helpers and tile kernels on small literals."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import relops
from strandlake.plans import libraries, tiles


def contigs(spark, *seqs):
    return spark.createDataFrame([(i, f"c{i}", s, len(s)) for i, s in enumerate(seqs)], "ci long, name string, seq string, len long")


@pytest.mark.parametrize(("weights", "total", "seats"), [([1, 2, 3], 10, [2, 3, 5]), ([1, 1, 1], 2, [1, 1, 0]), ([0, 5, 5], 1, [0, 1, 0])])
def test_hamilton(spark, weights, total, seats):
    rows = spark.createDataFrame(list(enumerate(weights)), "ci long, weight long")
    assert [r["seats"] for r in relops.hamilton(rows, total, "weight", "ci").orderBy("ci").collect()] == seats


@pytest.mark.parametrize(("weights", "total", "seats"), [([0.1, 0.2, 0.7], 10, [1, 2, 7]), ([0.0, 0.25, 0.75], 5, [0, 1, 4])])
def test_hamilton_real(spark, weights, total, seats):
    rows = spark.createDataFrame(list(enumerate(weights)), "ci long, weight double")
    assert [r["seats"] for r in relops.hamilton_real(rows, total, "weight", "ci").orderBy("ci").collect()] == seats


def test_cuts_overlap_and_coalesce(spark):
    c = contigs(spark, "CCGGACCTAAGGNCCTNAGG")
    got = tiles.cut_places(c, [("CCGG", 1), ("CCTNAGG", 4)]).orderBy("pos").collect()
    assert [(r["pos"], r["sites"]) for r in got] == [(1, 1), (9, 1)]
    got = tiles.cut_places(contigs(spark, "CC"), [("C", 0), ("CC", 0)]).orderBy("pos").collect()
    assert [(r["pos"], r["sites"]) for r in got] == [(0, 2), (1, 1)]


def test_cut_pairs(spark, monkeypatch):
    monkeypatch.setattr(libraries, "SHORTEST", 3)
    monkeypatch.setattr(libraries, "LONGEST", 6)
    cuts = tiles.cut_places(contigs(spark, "CAACAAC"), [("C", 0)])
    got = libraries.candidate_pairs(cuts).orderBy("left", "right").collect()
    assert [(r["left"], r["right"], r["sites"]) for r in got] == [(0, 3, 2), (0, 6, 3), (3, 6, 2)]


@pytest.mark.parametrize("core", [3, 7, 50, 65536])
def test_tiles_do_not_change_results(spark, core, monkeypatch):
    seq = "ACGTNCCGGTACAGCTGNNACGCAGTCCGTA" * 4
    c = contigs(spark, seq, seq[5:60])
    want = {tuple(r) for r in tiles.contexts(c).collect()}, {tuple(r) for r in tiles.valid_starts(c, 5, 17, 1).collect()}, {tuple(r) for r in tiles.cut_places(c, [("CNG", 1), ("GT", 2)]).collect()}
    plain = tiles.tiles
    monkeypatch.setattr(tiles, "tiles", lambda rows, halo, _=0: plain(rows, halo, core))
    got = {tuple(r) for r in tiles.contexts(c).collect()}, {tuple(r) for r in tiles.valid_starts(c, 5, 17, 1).collect()}, {tuple(r) for r in tiles.cut_places(c, [("CNG", 1), ("GT", 2)]).collect()}
    assert got == want


def test_range_and_overlap_joins(spark):
    points = spark.createDataFrame([(1, p) for p in range(0, 40, 3)], "k int, p long")
    spans = spark.createDataFrame([(1, 2, 9), (1, 9, 10), (1, 0, 39), (2, 0, 50)], "k int, s long, e long")
    want = {(p, s, e) for p in range(0, 40, 3) for s, e in ((2, 9), (9, 10), (0, 39)) if s <= p < e}
    for width in (1, 4, 100):
        rows = relops.range_join(points, spans, ["k"], "p", "s", "e", width).collect()
        assert len(rows) == len(want) and {(r["p"], r["s"], r["e"]) for r in rows} == want
        other = spans.selectExpr("k", "s as s2", "e as e2")
        rows = relops.overlap_join(spans, other, ["k"], "s", "e", "s2", "e2", width).where("k = 1").collect()
        pairs = [(2, 9), (9, 10), (0, 39)]
        assert sorted((r["s"], r["e"], r["s2"], r["e2"]) for r in rows) == sorted((a, b, c, d) for a, b in pairs for c, d in pairs if a < d and c < b)


def test_islands(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 6), (1, 8, 9), (2, 0, 1)], "k int, s long, e long")
    assert sorted(tuple(r) for r in relops.islands(rows, ["k"], "s", "e").collect()) == [(1, 0, 6), (1, 8, 9), (2, 0, 1)]


def test_ordered_accept_and_first_accepted(spark):
    rows = spark.createDataFrame([(1, o, 2) for o in (0, 3, 4, 9)], "k int, o long, need long")
    assert [(r["o"], r["accept_rank"], r["skipped"]) for r in relops.ordered_accept(rows, ["k"], "o", "need").orderBy("o").collect()] == [(0, 0, 0), (3, 1, 2)]
    tries = spark.createDataFrame([(1, 0, "a", False), (1, 2, "c", True), (1, 1, "b", True), (2, 0, "x", False)], "k int, t int, v string, ok boolean")
    assert [tuple(r) for r in relops.first_accepted(tries, ["k"], "t", "ok").collect()] == [(1, 1, "b")]


def _every(gap, upto):
    """Accepts the ordinals 7, 7 + gap, ... below ``upto``."""
    return lambda seats, lo, hi: seats.select("ci", "seats", F.explode(F.sequence(lo * F.col("seats"), hi * F.col("seats") - 1)).alias("candidate")).where((F.col("candidate") % gap == 7) & (F.col("candidate") < upto))


def test_variable_inserts_fill_every_seat(spark):
    seats = spark.createDataFrame([(0, 2), (1, 0)], "ci long, seats long")
    got = libraries.enough(seats, _every(50021, 10**9), 3).collect()
    assert sorted((r["candidate"], r["skipped"]) for r in got) == [(7, 7), (50028, 50027)]
    for gap, upto in ((50021, 8), (100_002, 10**9)):
        with pytest.raises(ArithmeticError):
            libraries.enough(seats, _every(gap, upto), 3)


def test_same_rows(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(3, 4), (1, 2)], "x int, y int")
    assert relops.same_rows(a, b, ["x", "y"]) and not relops.same_rows(a, b.where("x = 1"), ["x", "y"]) and not relops.same_rows(a.where("x = 1"), b, ["x", "y"])


def test_exact_weights(spark):
    rows = spark.createDataFrame([(0, 3.0), (1, 0.0)], "ci long, score double")
    assert sorted(r["score"] for r in libraries.exact_weights(rows, "score").collect()) == [0, 3]
    for bad in (0.5, -1.0, 2.0**32, float("nan"), None):
        with pytest.raises(ValueError):
            libraries.exact_weights(spark.createDataFrame([(0, bad)], "ci long, score double"), "score")


def test_targets_far_from_readable_starts(spark):
    c = contigs(spark, "ACGT" * 30 + "N" * 2000)
    runs = tiles.valid_runs(c, 20, 60, 8)
    picked = spark.createDataFrame([(0, 0, 0, 30), (0, 1, 1, 1500)], "ci long, ordinal long, target long, middle long")
    got = {r["ordinal"]: r["start"] for r in libraries.displaced_picks(picked, runs, 1, 15.0, strict=False).collect()}
    assert got[0] is not None and got[1] is None
    with pytest.raises(ArithmeticError):
        libraries.displaced_picks(picked, runs, 1, 15.0, strict=True)


def _haplotype(seq, events, hap):
    """(bases, place of each boundary or None inside a deletion, origins, event places) by plain loops."""
    bases, place, origin, places, at = "", [None] * (len(seq) + 1), [], [], 0
    for start, end, alt, mask in sorted(events):
        if not mask >> hap & 1:
            continue
        for r in range(at, start):
            place[r] = len(bases) if place[r] is None else place[r]
            bases += seq[r]
            origin.append(r)
        place[start] = len(bases) if place[start] is None else place[start]
        places.append((len(bases), len(bases) + len(alt)))
        origin += range(start, end) if len(alt) == end - start else [-1] * len(alt)
        bases += alt
        at = end
    for r in range(at, len(seq)):
        place[r] = len(bases) if place[r] is None else place[r]
        bases += seq[r]
        origin.append(r)
    place[len(seq)] = len(bases) if place[len(seq)] is None else place[len(seq)]
    return bases, place, origin, places


@pytest.mark.parametrize("core", [7, 64, 100_000])
def test_projected_starts_match_plain_loops(spark, core):
    import random

    from strandlake.plans import haplotiles

    rng = random.Random(core)
    read, insert, max_n = 5, 17, 1
    seqs, events = [], []
    for ci in range(3):
        seq = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(150 + 40 * ci))
        seqs.append(seq)
        at = 3
        while at < len(seq) - 8:
            kind, mask = rng.randrange(3), rng.randint(1, 3)
            size = rng.randint(1, 5)
            alt = "".join(rng.choice("ACGT") for _ in range(size))
            events.append((ci, at, *((at + 1, alt[0]) if kind == 0 else (at, alt) if kind == 1 else (at + size, "")), mask))
            at += rng.randint(7, 25)
    table = spark.createDataFrame(events, "ci long, ref_start long, ref_end long, alt_bases string, mask int")
    tiled = haplotiles.tiled(contigs(spark, *seqs), table, insert + 8, core)
    want, chances = {}, {}
    for ci, seq in enumerate(seqs):
        for hap in (0, 1):
            bases, place, _, _ = _haplotype(seq, [e[1:] for e in events if e[0] == ci], hap)
            for s in range(len(seq) - insert + 1):
                p, q = place[s], place[s + insert]
                if p is None or q is None or q - p < read or bases[p : p + read].count("N") > max_n or bases[q - read : q].count("N") > max_n:
                    continue
                want[ci, s] = want.get((ci, s), 0) | 1 << hap
                gc, size = sum(bases[p:q].count(c) for c in "CG") * 10, q - p
                key = ci, hap, gc // size + (gc % size * 2 >= size)
                chances[key] = chances.get(key, 0) + 1
    got = {(r["ci"], s): r["mask"] for r in haplotiles.mask_runs(tiled, read, insert, max_n).collect() for s in range(r["first"], r["last"] + 1)}
    assert got == want
    counts = haplotiles.opportunities(tiled, read, insert, max_n, 11).groupBy("ci", "hap", "bin").agg(F.sum("n").alias("n")).collect()
    assert {(r["ci"], r["hap"], r["bin"]): r["n"] for r in counts} == chances
    asked = spark.createDataFrame([(i, ci, s, insert, h) for i, (ci, s) in enumerate(sorted(want)) for h in (0, 1) if want[ci, s] >> h & 1], "ordinal long, ci long, start long, span long, haplotype int")
    for r in haplotiles.templates(tiled, asked, read, max_n, core).collect():
        bases, place, _, places = _haplotype(seqs[r["ci"]], [e[1:] for e in events if e[0] == r["ci"]], r["haplotype"])
        a, b = place[r["start"]], place[r["start"] + insert]
        assert r["ok"] and r["template"] == bases[a:b]
        held = [f"{max(x, a) - a}:{min(y, b) - a}" for x, y in places if (a < x < b if x == y else max(x, a) < min(y, b))]
        assert [":".join(e.split(":")[:2]) for e in filter(None, r["events"].split(","))] == held


@pytest.mark.parametrize("core", [50, 333, 100_000])
def test_mutations_do_not_depend_on_tiles(spark, core, monkeypatch):
    import random

    from strandlake.plans import models

    rng = random.Random(2)
    c = contigs(spark, *["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(n)) for n in (3000, 700, 3)])
    want = sorted(map(tuple, models.mutations(c, 0.1, 0.5, 0.6, 3).collect()))
    plain = tiles.tiles
    monkeypatch.setattr(tiles, "tiles", lambda rows, halo: plain(rows, 200, core))
    assert sorted(map(tuple, models.mutations(c, 0.1, 0.5, 0.6, 3).collect())) == want and len(want) > 200
    with pytest.raises(Exception, match="too dense"):
        models.mutations(c, 0.999, 0.5, 0.6, 3).collect() if core < 3000 else (_ for _ in ()).throw(ArithmeticError("too dense"))


def test_running_ranges_by_blocks(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(k % 3, rng.randrange(1000), rng.randrange(5), i) for i, k in enumerate(range(300))], "k int, at long, w long, i int")
    whole = sorted(map(tuple, relops.running_ranges(rows, ["k"], "w", ["at", "i"]).collect()))
    assert sorted(map(tuple, relops.running_ranges(rows, ["k"], "w", ["at", "i"], F.floor(F.col("at") / 64)).collect())) == whole
    whole = sorted(map(tuple, relops.numbered(rows, ["k"], "n", ["at", "i"]).collect()))
    assert sorted(map(tuple, relops.numbered(rows, ["k"], "n", ["at", "i"], F.floor(F.col("at") / 64)).collect())) == whole
