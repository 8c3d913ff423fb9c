"""Plans that read their tables once, and the kernels that make that possible."""

import random
import re

import numpy as np

from strandlake.functions import philox as rng
from strandlake.plans import haplotiles, libraries, load

DATA = "/root/testdata/sf0.001"


def scans(rows, column):
    """How often the plan reads the table that has ``column``."""
    return len(re.findall(rf"Relation \[[^\]]*\b{column}#", rows._jdf.queryExecution().optimizedPlan().toString()))


def test_rrbs_diploid_candidates_reads_items_once(spark):
    assert scans(load()[0]["rrbs_diploid_candidates"](spark, DATA), "l_orderkey") == 1


def _fragments(seq, events, shortest, longest, read, max_n):
    """Restriction fragments at CG and CNGG (cut after the C) of both haplotypes, base by base."""
    found = {}
    for hap in (0, 1):
        bases, ref, inside, at = "", [], [], 0
        for start, end, alt in [(s, e, a) for s, e, a, m in events if m >> hap & 1] + [(len(seq), len(seq), "")]:
            bases, ref, inside = bases + seq[at:start], ref + list(range(at, start)), inside + [False] * (start - at)
            ref, inside = ref + [start + min(k, end - start) for k in range(len(alt))], inside + [start == end and k > 0 for k in range(len(alt))]
            bases, at = bases + alt, end
        ref.append(len(seq))
        inside.append(False)
        cuts = {}
        for motif in ("(?=CG)", "(?=C[ACGT]GG)"):
            for m in re.finditer(motif, bases):
                cuts[m.start() + 1] = cuts.get(m.start() + 1, 0) + 1
        cuts = {p: n for p, n in cuts.items() if not inside[p]}
        for p in cuts:
            for q in cuts:
                t = bases[p:q]
                if shortest <= q - p <= longest and t[:read].count("N") <= max_n and t[-read:].count("N") <= max_n:
                    row = ref[p], ref[q], q - p, t.count("C") + t.count("G"), sum(n for c, n in cuts.items() if p <= c <= q)
                    found[row] = found.get(row, 0) | 1 << hap
    return sorted((*row, mask) for row, mask in found.items())


def test_restriction_fragments_do_not_depend_on_tiles(spark):
    draw = random.Random(3)
    contigs, events, want = [], [], []
    for ci in range(3):
        seq = "".join(draw.choices("ACGTN", (3, 4, 4, 3, 1), k=700))
        own = []
        for pos in [0, *range(5, 690, 7), 699]:
            kind = draw.randrange(4)
            start, end, alt = [(pos, pos + 1, "ACGT"[pos % 4]), (pos, pos, draw.choice(("CG", "GCGC", "T"))), (pos, min(pos + 2, 700), ""), (pos, min(pos + 2, 700), "CG")][kind]
            if kind != 3 or end - start == 2:
                own.append((start, end, alt, draw.randrange(1, 4)))
        contigs.append((ci, seq, len(seq)))
        events += [(ci, *e) for e in own]
        want += [(ci, *r) for r in _fragments(seq, own, 10, 40, 5, 1)]
    c = spark.createDataFrame(contigs, "ci long, seq string, len long")
    e = spark.createDataFrame(events, "ci long, ref_start long, ref_end long, alt_bases string, mask int")
    for core in (37, 128, 4096):
        got = haplotiles.restriction(haplotiles.tiled(c, e, 150, core), [("CG", 1), ("CNGG", 1)], 10, 40, 5, 1)
        assert sorted(map(tuple, got.collect())) == want, core


def test_tbs_displaced_reads_items_twice(spark, monkeypatch):
    read, keep = [], libraries.kept
    monkeypatch.setattr(libraries, "kept", lambda rows: (read.append(scans(rows, "l_orderkey")), keep(rows))[1])
    load()[0]["tbs_displaced"](spark, DATA)
    assert sum(read) == 2


def test_displacement_takes_no_rounds_of_jobs(spark, monkeypatch):
    """A start at a distance that 100,000 attempts rarely draw, or never, costs one pass like any other."""
    away = [0, 30, -45, 58, 66, 127, 1000]
    runs = [(ci, 500 + d, 501 + d) for ci, d in enumerate(away)]
    picked = spark.createDataFrame([(ci, 3, 9, 500) for ci in range(len(away))], "ci long, ordinal long, target long, middle long")
    calls, keep = [], libraries.kept
    monkeypatch.setattr(libraries, "kept", lambda rows: (calls.append(1), keep(rows))[1])
    rows = libraries.displaced_picks(picked, spark.createDataFrame(runs, "ci long, pos long, stop long"), 11, 15.0, strict=False)
    got = {r["ci"]: (r["attempt"], r["start"]) for r in rows.collect()}
    assert len(calls) <= 2
    k = np.arange(libraries.MOST_ATTEMPTS, dtype=np.uint64)
    for ci, d in enumerate(away):
        key = rng.stage_key(11, rng.FRAGMENT, np.array([ci]))
        shift = np.trunc(15.0 * rng.normal(np.broadcast_to(key, k.shape), np.full(len(k), 3, np.uint64), k + np.uint64(2)))
        hits = np.flatnonzero(shift == d)
        assert got[ci] == ((int(hits[0]), 500 + d) if len(hits) else (None, None))
    assert got[5] == got[6] == (None, None)
