"""Counter-addressed random numbers: Philox4x32-10 as a numpy kernel and as Spark columns.

A draw is a pure function of (seed, stage, contig, entity, local), so any partitioning, retry or lost
executor gives the same rows.  The kernel runs in Arrow batches; what follows it (uniforms, coins, bounded
integers) is plain BIGINT and DOUBLE arithmetic on the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator and of its key schedule.
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
WEYL = (0x9E3779B9, 0xBB67AE85)
KEY_TAG = 0x4253522F4B455932
MUTATION, METHYLATION_LEVEL, FRAGMENT, HAPLOTYPE, SITE_STATE, ORIENTATION, CONVERSION, QUALITY, SEQUENCING_ERROR = range(9)

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
WORDS = "w0 long, w1 long, w2 long, w3 long"


def block(key: np.ndarray, entity: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, ...]:
    """Four 32-bit words (in uint64) of each 64-bit key and 128-bit counter."""
    key, entity, local = (np.asarray(x, dtype=np.uint64) for x in (key, entity, local))
    c = [entity & _LOW, entity >> _HALF, local & _LOW, local >> _HALF]
    k0, k1 = key & _LOW, key >> _HALF
    for _ in range(10):
        p0, p1 = c[0] * np.uint64(MULTIPLIERS[0]), c[2] * np.uint64(MULTIPLIERS[1])
        c = [(p1 >> _HALF) ^ c[1] ^ k0, p1 & _LOW, (p0 >> _HALF) ^ c[3] ^ k1, p0 & _LOW]
        k0, k1 = (k0 + np.uint64(WEYL[0])) & _LOW, (k1 + np.uint64(WEYL[1])) & _LOW
    return tuple(c)


def stage_key(seed: int, stage: int, contig: np.ndarray | int) -> np.ndarray:
    """The 64-bit key of a stage and contig under a seed."""
    local = np.asarray(contig, dtype=np.uint64) | np.uint64(stage << 32)
    w = block(np.uint64(seed % 2**64), np.uint64(KEY_TAG), local)
    return w[0] | w[1] << _HALF


def unsigned(values) -> np.ndarray:
    """Signed 64-bit columns as the bit patterns that they stand for."""
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def words(seed: int, stage: int, contig: np.ndarray, entity: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, ...]:
    distinct, place = np.unique(np.asarray(contig, dtype=np.int64), return_inverse=True)
    return block(stage_key(seed, stage, distinct)[place], unsigned(entity), unsigned(local))


def uniform(w: tuple[np.ndarray, ...], pair: int = 0) -> np.ndarray:
    """The top 53 bits of a word pair as a double in [0, 1)."""
    return ((w[2 * pair + 1] << np.uint64(21)) | (w[2 * pair] >> np.uint64(11))).astype(np.float64) * 2.0**-53


def normal(key: np.ndarray, entity: np.ndarray, local: np.ndarray) -> np.ndarray:
    """Box-Muller on the two pairs of one block."""
    w = block(key, entity, local)
    top = lambda lo, hi: ((hi << np.uint64(21)) | (lo >> np.uint64(11))).astype(np.float64)
    u1, u2 = (top(w[0], w[1]) + 1) * 2.0**-53, top(w[2], w[3]) * 2.0**-53
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


def draw(seed: int, stage: int, contig: Column, entity: Column, local: Column) -> Column:
    """struct<w0..w3> of the address; 64-bit addresses travel as signed bit patterns."""

    @F.pandas_udf(WORDS)
    def run(contig: pd.Series, entity: pd.Series, local: pd.Series) -> pd.DataFrame:
        w = words(seed, stage, contig.to_numpy(), entity.to_numpy(), local.to_numpy())
        return pd.DataFrame({f"w{i}": x.astype(np.int64) for i, x in enumerate(w)})

    return run(contig.cast("long"), entity.cast("long"), local.cast("long"))


def pick(seed: int, stage: int, contig: Column, entity: Column, local: Column, width: Column) -> Column:
    """``bounded`` of the address's draw, inside the kernel: for plans that use the pick many times."""

    @F.pandas_udf("long")
    def run(contig: pd.Series, entity: pd.Series, local: pd.Series, width: pd.Series) -> pd.Series:
        n, carry = width.to_numpy().astype(np.uint64), np.zeros(len(width), np.uint64)
        for w in words(seed, stage, contig.to_numpy(), entity.to_numpy(), local.to_numpy()):
            carry = (w * n + carry) >> _HALF
        return pd.Series(carry.astype(np.int64))

    return run(contig.cast("long"), entity.cast("long"), local.cast("long"), width.cast("long"))


def clamped_normal(seed: int, stage: int, contig: Column, entity: Column, local: Column, least: int, mean: int, most: int, sd: float) -> Column:
    """mean + trunc(sd * z) between ``least`` and ``most``, inside the kernel."""

    @F.pandas_udf("long")
    def run(contig: pd.Series, entity: pd.Series, local: pd.Series) -> pd.Series:
        distinct, place = np.unique(contig.to_numpy(), return_inverse=True)
        z = normal(stage_key(seed, stage, distinct)[place], unsigned(entity.to_numpy()), unsigned(local.to_numpy()))
        return pd.Series(np.clip(mean + np.trunc(sd * z), least, most).astype(np.int64))

    return run(contig.cast("long"), entity.cast("long"), local.cast("long"))


def uniform01(w: Column, pair: int = 0) -> Column:
    lo, hi = w[f"w{2 * pair}"], w[f"w{2 * pair + 1}"]
    return (F.shiftleft(hi, 21).bitwiseOR(F.shiftright(lo, 11))).cast("double") * F.lit(2.0**-53)


def bernoulli(w: Column, p: Column) -> Column:
    return (p > 0) & ((p >= 1) | (uniform01(w) < p))


def bounded(w: Column, width: Column) -> Column:
    """floor(r * width / 2**128) of the 128-bit draw r, for 0 < width < 2**31, by carries in BIGINT."""
    carry = F.lit(0).cast("long")
    for k in range(4):
        carry = F.shiftright(w[f"w{k}"] * width.cast("long") + carry, 32)
    return carry


def pair_hex(w: Column, pair: int = 0) -> Column:
    """A word pair as 16 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(w[f"w{2 * pair + 1}"]), 8, "0"), F.lpad(F.hex(w[f"w{2 * pair}"]), 8, "0")))
