"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (lengths ``SIZES``, lower case) by language give a log-probability matrix of
2**BITS rows and one column a language, which is broadcast (languages x 65,536 floats); texts are scored
in numpy by gathering the rows of their n-grams and summing them by text, ``CELLS`` numbers at a time
whatever the number of languages and the length of a text.  No n-gram reaches from one text into the next, so
a prediction depends on its text alone, to the last bit.

Contract: one row per input row.  ``und`` with score 0 if the text is null or has no letter; also where no
language could be learned.  The score is the posterior of the predicted language; ties go to the
first language in alphabetical order.  Repeated rows are predicted alike; only the text is an input.

Bound: at most about ``max_rows`` texts of each language are learned from: all of them, or those whose
id hash lies below the share that gives ``max_rows``.  They are counted on the executors, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import aligned, code_points, text_slices
from .store import crc_bucket, project

SIZES = (1, 2, 3)
BITS = 16
MAX_ROWS = 3000
#: Log-probabilities gathered at once.
CELLS = 4_000_000
_LETTER = re.compile(r"[^\W\d_]")


def _bucket_counts(texts: list[str | None]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for _, part in text_slices(texts):
        cp, offsets = code_points(part)
        for n in SIZES:
            g, own = aligned(cp, offsets, n, BITS)
            total += np.bincount(g[own], minlength=1 << BITS)
    return total


def _pieces(offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, text) of pieces of at most ``most`` places; every text is cut from its own start."""
    count = np.maximum(1, -(-np.diff(offsets) // most))
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[text] + nth * most, text


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # float32 [2**BITS, languages]
    prior: np.ndarray

    @staticmethod
    def of(counts: dict[str, np.ndarray], texts: dict[str, int], alpha: float = 0.5) -> Model:
        langs = sorted(counts)
        c = np.array([counts[k] for k in langs], dtype=np.float64).reshape(len(langs), 1 << BITS) + alpha
        logp = np.log(c / c.sum(axis=1, keepdims=True)).T
        n = np.array([texts[k] for k in langs], dtype=np.float64)
        return Model(langs, np.ascontiguousarray(logp, dtype=np.float32), np.log(n / n.sum()) if len(n) else n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        for lo, part in text_slices(texts):
            cp, offsets = code_points(part)
            ll = np.tile(self.prior, (len(part), 1))
            most = max(1, CELLS // len(self.langs))
            at, text = _pieces(offsets, most)
            for n in SIZES:
                g, own = aligned(cp, offsets, n, BITS)
                a = 0
                while a < len(at):
                    b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
                    stop = at[b] if b < len(at) else len(cp)
                    rows = np.where(own[at[a] : stop, None], self.logp[g[at[a] : stop]], np.float32(0))
                    np.add.at(ll, text[a:b], np.add.reduceat(rows, at[a:b] - at[a], axis=0, dtype=np.float64))
                    a = b
            best = ll.argmax(axis=1)
            post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            for i, t in enumerate(part):
                if _LETTER.search(t):
                    lang[lo + i], score[lo + i] = self.langs[best[i]], post[i]
        return lang, score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    if not found:
        return Model.of({}, {})
    below = [F.lit(k) for kv in ((k, min(1.0, max_rows / n)) for k, n in found.items()) for k in kv]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(place < F.create_map(*below)[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            t, names = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for k in set(names):
                held[k] = held.get(k, 0) + _bucket_counts([x for x, y in zip(t, names, strict=True) if y == k])
        for k, c in held.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    # languages x 2**BITS rows at most reach the driver, however large the corpus.
    out = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(1 << BITS) for k in found}
    for k in counts:
        part = out.filter(pa.compute.equal(out["lang"], k))
        counts[k][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model.of(counts, found)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch["text"].to_pylist())
            yield pa.record_batch([batch["doc_id"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return project(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_query(docs: DataFrame) -> DataFrame:
    """Predict all of ``docs`` after learning from those outside the held-out quarter."""
    model = train(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
