"""Near-duplicate documents by HyperMinHash registers, banding, estimation and exact verification.

A document's set holds its distinct shingles of ``SHINGLE`` = 5 words (A-Z lower-cased); with fewer words
the whole sequence is one shingle; without words the set is empty and links with nothing.  Documents link
if 100 * intersection >= 75 * union.

1. Registers.  One hash of each shingle picks one of 256 buckets; a bucket keeps its smallest remaining
   hash as a 16-bit register: leading zeros (6 bits) and the MANTISSA = 10 bits after the first one.  Empty buckets
   take over the register of another bucket, in an order of their own, so that small sets band as well.
2. Copies.  Documents with equal sets form a class at once (128-bit sum of their hashes); only the class's
   smallest id goes on, so thousands of copies cost one document.
3. Bands.  51 bands of 5 registers.  At a similarity of 0.75 a pair misses all with probability 1e-6.
4. Hubs.  In every band bucket each class is paired with one only, that which meets most others over all
   its bands (a group's original rather than one of its edited copies).  The estimate (share of equal
   registers, corrected for chance collisions) drops pairs that lie more than 4.5 standard errors below
   the limit; the others are verified on the full sets of the texts.
5. Components of those links.  A band bucket whose classes now all lie in one component needs nothing more,
   as further links cannot join anything.  The classes of the others are open; what could still link them
   across components is bounded exactly before any pair is made:
   - reach: how many of a class's shingles an open class of another component has.  A link needs an
     intersection of 3/7 of both sizes, so a class whose reach is below 3/4 of its size is closed.
   - An open class y is compared, on full sets, with the hub h of each larger component that it meets.
     For any other x of that component |x & y| <= |h & y| + |x - h within reach|, which tells the few x
     that are worth a comparison with y.  Those pairs are estimated and verified as well.
   - Of two classes that link, the one that is not larger has a reach of at least 6/7 of its size, as the
     intersection is 6/7 of it.  Only such full classes meet all others of their bands; those that are not
     meet full ones alone.  So documents that share a long passage, or most of a form, without linking
     are never paired with each other.
   So no link that shares a band is lost.  What is left of pairs is full classes times the components of their
   band, and members of a component that a comparison with its hub could not rule out.

Contract: one row per input row of non-null id: doc_id, n_shingles, component_id (smallest id reachable, its own
at least), kept.  Null and empty texts: 0 shingles, own component, kept.  Rows that share an id are taken as
versions of one document: each gives a row with its own n_shingles, and all get the smallest id that any of them
reaches; equal rows get equal results.  Ties do not arise: ids decide.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import U64, Words, mix, slices, string_buffers, windows
from .store import materialise, project

SHINGLE = 5
REGISTERS = 256
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
MANTISSA = 10
LIMIT = 75
EMPTY = np.uint16(0xFFFF)
#: Pairs are verified whose estimate is at least this: 0.75 less 4.5 standard errors of 256 registers.
ESTIMATE_FLOOR = 0.75 - 4.5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: The chance that registers of different minima agree: a third for the zeros, 2**-10 for the mantissa.
CHANCE = 1 / 3 / 2**MANTISSA

_ORDER = np.argsort(np.random.default_rng(5).random((REGISTERS, REGISTERS)), axis=1)
_SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, registers binary"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in slices(offsets):
        w = Words(raw, offsets, lo, hi, lower=True)
        h = w.hashes()
        every = windows(h, SHINGLE)
        for d in range(hi - lo):
            a, b = int(w.first[d]), int(w.first[d + 1])
            if b - a >= SHINGLE:
                yield np.unique(every[a : b - SHINGLE + 1])
            else:
                yield windows(h[a:b], b - a) if b > a else np.zeros(0, U64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of 64-bit hashes (all EMPTY for the empty set)."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> U64(56)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
    rest = (shingles[first] << U64(8)) >> U64(8)  # 56 bits; sorted, so the first is the least
    # Exact in 53 bits after dropping the three lowest, which no mantissa of 10 bits reaches but for
    # the smallest of hashes, where registers just agree a little more often.
    share, power = np.frexp((rest >> U64(3)).astype(np.float64))
    zeros = np.minimum(53 - power, 60)
    zeros[rest >> U64(3) == 0] = 60
    mantissa = np.clip((share * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1)
    out[bucket[first]] = zeros.astype(np.int64) << MANTISSA | mantissa.astype(np.int64)
    gaps = np.flatnonzero(out == EMPTY)
    if len(gaps):
        filled = out != EMPTY
        order = _ORDER[gaps]
        out[gaps] = out[order[np.arange(len(gaps)), filled[order].argmax(axis=1)]]
    return out


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """[documents, BANDS] hashes of each band's registers."""
    parts = regs[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(U64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
        for k in range(BAND_ROWS):
            h = mix(h ^ (parts[:, :, k] + U64(k << 20)))
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of register rows."""
    same = (a == b).mean(axis=1)
    return np.maximum(0, (same - CHANCE) / (1 - CHANCE))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k1, k2, regs = [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(*string_buffers(batch["text"])):
                n.append(len(s))
                k1.append(int(s.sum(dtype=U64).view(np.int64)))
                k2.append(int(mix(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64).view(np.int64)))
                regs.append(registers(s).tobytes())
        yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "registers"])


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            h = band_hashes(_register_rows(part["registers"])).view(np.int64)
            yield pa.record_batch([pa.array(h.ravel()), pa.array(np.repeat(part["doc_id"].to_numpy(), BANDS))], ["band", "doc_id"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            e = estimate(_register_rows(batch["ra"]), _register_rows(batch["rb"]))
            yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(e >= ESTIMATE_FLOOR))


def linked(both: int, a: int, b: int) -> bool:
    """100 * intersection >= LIMIT * union."""
    return both > 0 and 100 * both >= LIMIT * (a + b - both)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, both): the size of the intersection of the texts' full sets, and whether they link."""
    for batch in batches:
        held_id, held, both, link = None, None, [], []
        hubs = batch["b"].to_pylist()
        left = shingle_sets(*string_buffers(batch["ta"]))
        for i, (hub, a) in enumerate(zip(hubs, left, strict=True)):
            if hub != held_id:
                held_id, held = hub, next(shingle_sets(*string_buffers(batch["tb"].slice(i, 1))))
            both.append(len(np.intersect1d(a, held, assume_unique=True)))
            link.append(linked(both[-1], len(a), len(held)))
        yield pa.record_batch([batch["a"], batch["b"], pa.array(both, pa.int64()), pa.array(link, pa.bool_())], ["a", "b", "both", "link"])


def _compare(pairs: DataFrame, known: DataFrame, tag: str) -> DataFrame:
    """(a, b, both, link) of ``pairs`` (a, b) on the full sets."""
    ta, tb = (known.select(F.col("doc_id").alias(x), F.col("text").alias("t" + x)).hint("merge") for x in "ab")
    return materialise(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_overlap, "a long, b long, both long, link boolean"), tag, narrow=True)


def _links(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that the estimate lets pass and the full sets confirm."""
    a, b = (known.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n" + x), F.col("registers").alias("r" + x)).hint("merge") for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.expr(f"100 * least(na, nb) >= {LIMIT} * greatest(na, nb)"))
    near = materialise(near.select("a", "b", "ra", "rb").mapInArrow(_near, "a long, b long"), "near", narrow=True)
    return _compare(near, known, "links").where("link").select("a", "b")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            sets = list(shingle_sets(*string_buffers(part["text"])))
            n = np.array([len(x) for x in sets], np.int64)
            columns = [np.repeat(part[c].to_numpy(), n) for c in ("doc_id", "comp")] + [np.repeat(n, n), np.concatenate(sets).view(np.int64)]
            yield pa.record_batch([pa.array(x) for x in columns], ["doc_id", "comp", "n", "shingle"])


def _reach(open_: DataFrame, centres: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, comp, n, reach, beyond) of the open classes whose reach is large enough for a link.

    beyond: how many of a class's shingles are within its reach, but not in the set of its component's hub
    (0 for the hub itself).  ``centres`` holds (comp, hub).
    """
    members = open_.select("doc_id", "comp").unionByName(centres.select(F.col("hub").alias("doc_id"), "comp")).distinct()
    rows = known.select("doc_id", "text").hint("merge").join(members, "doc_id").select("doc_id", "comp", "text").mapInArrow(_shingle_rows, "doc_id long, comp long, n long, shingle long")
    rows = materialise(rows, "shingles")
    crossing = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    reached = rows.join(crossing, "shingle", "left_semi")
    in_hub = rows.join(centres.select(F.col("hub").alias("doc_id")), "doc_id", "left_semi").select("comp", "shingle", F.lit(1).alias("central"))
    reach = reached.join(in_hub, ["comp", "shingle"], "left").groupBy("doc_id", "comp", "n").agg(F.count("*").alias("reach"), F.count(F.when(F.col("central").isNull(), 1)).alias("beyond"))
    return materialise(reach.where(f"100 * reach >= {LIMIT} * n").select("doc_id", "comp", "n", "reach", "beyond"), "reach", narrow=True)


def _joined(first: DataFrame, extra: DataFrame) -> DataFrame:
    """(rep, comp): the components ``first`` (node, comp) after ``extra`` links (a, b) have joined some."""
    of = lambda c: first.select(F.col("node").alias(c), F.col("comp").alias("c" + c))
    between = extra.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(between)
    alone = second.select("node").join(first.select("node"), "node", "left_anti").withColumn("comp", F.col("node"))
    later = second.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return first.unionByName(alone).join(later, "comp", "left").select(F.col("node").alias("rep"), F.coalesce("to", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = project(docs, id_col, text_col).where("doc_id IS NOT NULL")
    signed = materialise(docs.mapInArrow(_sign, _SIGNATURE), "signed", narrow=True)
    full = signed.where("n_shingles > 0")
    # A table of its own, so that the join of all copies to their class has two plain exchanges, of which
    # adaptive execution can split the partition of a set that very many documents have.
    classes = materialise(full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes", narrow=True)
    reps = full.select("doc_id", "registers").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    banded = reps.select("doc_id", "registers").mapInArrow(_band, "band long, doc_id long")
    several = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(banded.join(several, "band"), "met", narrow=True)
    # Only documents that share a band matter from here: their texts and registers are picked out once, by
    # the same kind of join at every size.
    meeting = signed.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "registers")
    known = materialise(docs.hint("merge").join(meeting, "doc_id"), "known")
    scored = met.join(met.groupBy("doc_id").agg(F.sum("n").alias("score")), "doc_id").select("band", "doc_id", "score")
    hubs = scored.groupBy("band").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("m")).select("band", (-F.col("m.minus")).alias("hub"))
    stars = materialise(met.join(hubs, "band").where("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")).distinct(), "stars", narrow=True)
    links = _links(stars, known)

    first = components(links)
    placed = met.select("band", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    open_ = materialise(placed.join(mixed, "band", "left_semi"), "open", narrow=True)

    # The hub of a component: its class that meets most others; the size orders components.
    scores = scored.select("doc_id", "score").distinct().join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    centres = scores.groupBy("comp").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("m"), F.count("*").alias("size"))
    centres = centres.join(open_.select("comp").distinct(), "comp", "left_semi").select("comp", (-F.col("m.minus")).alias("hub"), "size")
    centres = materialise(centres, "centres", narrow=True)
    able = _reach(open_, centres, known)
    # A link needs both reaches to be LIMIT / (100 + LIMIT) of both sizes; room is what a reach leaves for the
    # other's size.
    sized = able.join(centres, "comp").withColumn("room", F.expr(f"{100 + LIMIT} * reach - {LIMIT} * n"))
    sized = sized.withColumn("full", F.expr(f"room >= {LIMIT} * n"))
    spots = open_.select("band", "doc_id").join(sized, "doc_id")
    theirs = spots.groupBy("band", F.col("comp").alias("c"), F.col("size").alias("c_size"), F.col("hub").alias("c_hub")).agg(F.max("room").alias("c_room"), F.min("n").alias("c_least"), F.max("full").alias("c_full"))
    larger = f"comp <> c AND (c_size > size OR (c_size = size AND c < comp)) AND c_room >= {LIMIT} * n AND room >= {LIMIT} * c_least"
    both_ways = spots.where("full").join(theirs, "band").unionByName(spots.where("NOT full").join(theirs.where("c_full"), "band"))
    meets = both_ways.where(larger).select("doc_id", "n", "room", "full", "c", "c_hub").distinct()
    meets = materialise(meets, "meets", narrow=True)
    seen = _compare(meets.select(F.col("doc_id").alias("a"), F.col("c_hub").alias("b")), known, "hub_links")
    bound = meets.join(seen.select(F.col("a").alias("doc_id"), F.col("b").alias("c_hub"), "both"), ["doc_id", "c_hub"])
    inner = sized.where("doc_id <> hub").select(F.col("comp").alias("c"), F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("room").alias("room_x"), F.col("full").alias("full_x"), "beyond")
    worth = f"{100 + LIMIT} * (both + beyond) >= {LIMIT} * (n + nx) AND room >= {LIMIT} * nx AND room_x >= {LIMIT} * n"
    paired = bound.where("full").join(inner, "c").unionByName(bound.where("NOT full").join(inner.where("full_x"), "c"))
    rest = paired.where(worth).select(F.greatest("doc_id", "x").alias("a"), F.least("doc_id", "x").alias("b")).distinct()
    extra = materialise(seen.where("link").select("a", "b").unionByName(_links(rest, known)), "extra", narrow=True)
    member = materialise(signed.join(classes, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "members", narrow=True)
    # Versions of one id stay together.
    several_of = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    versions = member.join(several_of, "doc_id").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b")).distinct()
    found = _joined(first, extra.unionByName(versions))
    out = member.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).hint("rebalance")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that are the smallest id of their component, all columns."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


SQL = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + {SHINGLE - 1}), ' ')) AS h FROM words, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= {LIMIT} * (x.n + y.n - n_both)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM words w JOIN least USING (doc_id) LEFT JOIN sizes s ON s.doc_id = w.doc_id"""


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """The same by comparing all pairs that share a shingle, for tests."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else ({tuple(w)} if w else set())
    by, root = {}, {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        shared: dict[int, int] = {}
        for s in sets[i]:
            for j in by.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
            by.setdefault(s, []).append(i)
        for j, n in shared.items():
            if 100 * n >= LIMIT * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
