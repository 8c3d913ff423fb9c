"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each text is the set of its hashed character n-grams (lower case, lengths ``SIZES``).  The weight of a
bucket is its naive Bayes log-count ratio r (smoothed share among toxic over share among other labelled
texts); a logistic regression learns on x = r * presence.  Only the text is an input of a score.

Contract: one row per input row.  A null or empty text gets the score of a text without n-grams (the
classifier's intercept).  Labels that are null or of unknown documents are not learned from; with no
labelled row at all, or one class only, every score is that class's smoothed share.  Repeated rows are
scored alike; columns other than id and text are ignored, so clashing names do no harm.

Bound: at most ``max_rows`` labelled texts of each class are learned from (the smallest hashes of doc_id), and
of those, in that order, as many as fit in ``max_bytes`` of whole texts a class; they are read by bounded
joins and fitted on the driver in numpy.  Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import code_points, per_text, text_slices
from .store import crc_bucket, project

SIZES = (3, 4, 5)
BITS = 18
MAX_ROWS = 2500
MAX_BYTES = 32 << 20


@dataclass
class Model:
    weight: np.ndarray  # float32, one for each bucket: r times the learned coefficient
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        mark = np.zeros(len(self.weight), dtype=np.float32)
        for lo, part in text_slices(texts):
            cp, offsets = code_points(part)
            for i, gs in enumerate(per_text(cp, offsets, SIZES, BITS)):
                idx = np.concatenate(gs)
                if len(idx) < 2000:
                    idx = np.unique(idx)
                    z = float(self.weight[idx].sum())
                else:
                    mark[idx] = 1
                    z = float(mark @ self.weight)
                    mark[idx] = 0
                out[lo + i] = z
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -40, 40)))


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    return [np.unique(np.concatenate(gs)).astype(np.int32) for _, part in text_slices(texts) for gs in per_text(*code_points(part), SIZES, BITS)]


def fit(texts: list[str], labels: np.ndarray, rounds: int = 150, ridge: float = 2e-4, alpha: float = 1.0) -> Model:
    """Log-count ratios, then logistic regression by accelerated gradient steps on their presence."""
    y = labels.astype(np.float64)
    size = 1 << BITS
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    sets = _sets(texts)
    pos, neg = np.zeros(size), np.zeros(size)
    for u, label in zip(sets, y, strict=True):
        (pos if label else neg)[u] += 1
    r = np.log((pos + alpha) / (y.sum() + 2 * alpha)) - np.log((neg + alpha) / ((1 - y).sum() + 2 * alpha))
    # Only buckets that tell the classes apart carry weight: r's own standard error is the yardstick.
    sure = np.abs(r) > 2.5 * np.sqrt(1 / (pos + alpha) + 1 / (neg + alpha))
    for i, u in enumerate(sets):  # in place: the whole sets of thousands of texts are large
        sets[i] = u[sure[u]]
    cols = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets), dtype=np.int32), [len(u) for u in sets])
    del sets
    used, cols = np.unique(cols, return_inverse=True)
    x = r[used][cols]
    # Equal weight for either class, so that 0.5 is a threshold that does not depend on their mix.
    c = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    n_rows = len(y)
    w, b, v, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    norm = np.bincount(rows, weights=x * x, minlength=n_rows)
    step = 4.0 / (float((c * norm).sum()) + 1 + ridge)
    for k in range(rounds):
        z = np.bincount(rows, weights=x * v[cols], minlength=n_rows) + vb
        g = c * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(cols, weights=x * g[rows], minlength=len(used)) + ridge * v
        w2, b2 = v - step * grad, vb - step * g.sum()
        beta = k / (k + 3)
        v, vb = w2 + beta * (w2 - w), b2 + beta * (b2 - b)
        w, b = w2, b2
    weight = np.zeros(size, np.float32)
    weight[used] = r[used] * w
    return Model(weight, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on at most ``max_rows`` labelled texts and ``max_bytes`` of each class; ``labels`` holds (id, 0 or 1)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * max_rows rows of 20 bytes: a proven bound for the broadcast, and for the sizes that come to the driver.
    sized = project(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "place").agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    fits = within(sized.toArrow(), max_bytes)
    wanted = docs.sparkSession.createDataFrame(fits or [(0, 0)], "doc_id long, y int").limit(len(fits))
    rows = project(docs, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text").toArrow()
    texts, ids = rows["text"].to_pylist(), rows["doc_id"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return fit([texts[i] for i in order], rows["y"].to_numpy()[np.array(order, np.int64)])


def within(sized: pa.Table, max_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, y) of each class's first texts, by place, that fit in ``max_bytes`` together; one at least."""
    out, used = [], {0: 0, 1: 0}
    for r in sorted(sized.to_pylist(), key=lambda r: (r["place"], r["doc_id"])):
        if not used[r["y"]] or used[r["y"]] + r["size"] <= max_bytes:
            used[r["y"]] += r["size"] or 1
            out.append((r["doc_id"], r["y"]))
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch["text"].to_pylist())
            yield pa.record_batch([batch["doc_id"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return project(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all of ``docs`` after learning from the labels outside the held-out fifth."""
    model = train(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
