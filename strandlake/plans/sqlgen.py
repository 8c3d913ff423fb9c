"""SQL fragments of the oracle: the counter-based generator as a chain of common table expressions."""

from __future__ import annotations

from ..functions.philox import KEY_TAG, MULTIPLIERS, WEYL

_M = "4294967295::UBIGINT"


def rounds(name: str, source: str) -> str:
    """Ten rounds over ``source``, which has UBIGINT columns k0, k1, c0..c3; the result is ``name``."""
    out, last = [], source
    for i in range(10):
        this = name if i == 9 else f"{name}_{i}"
        out.append(
            f"{this} AS (SELECT * REPLACE (xor(xor((c2 * {MULTIPLIERS[1]}::UBIGINT) >> 32, c1), k0) AS c0, (c2 * {MULTIPLIERS[1]}::UBIGINT) & {_M} AS c1, "
            f"xor(xor((c0 * {MULTIPLIERS[0]}::UBIGINT) >> 32, c3), k1) AS c2, (c0 * {MULTIPLIERS[0]}::UBIGINT) & {_M} AS c3, "
            f"(k0 + {WEYL[0]}::UBIGINT) & {_M} AS k0, (k1 + {WEYL[1]}::UBIGINT) & {_M} AS k1) FROM {last})"
        )
        last = this
    return ",\n".join(out)


def draws(name: str, source: str, seed: int, stage: int, contig: str, entity: str, local: str) -> str:
    """``name``: the rows of ``source`` with words w0..w3 (BIGINT) of the address."""
    low, high = (lambda x: f"(({x})::UBIGINT & {_M})"), (lambda x: f"(({x})::UBIGINT >> 32)")
    keys = f"{name}_kq AS (SELECT DISTINCT ({contig})::BIGINT AS _contig, {low(seed)} AS k0, {high(seed)} AS k1, {low(KEY_TAG)} AS c0, {high(KEY_TAG)} AS c1, {low(contig)} AS c2, {stage}::UBIGINT AS c3 FROM {source})"
    body = f"{name}_in AS (SELECT s.*, k.c0 AS k0, k.c1 AS k1, {low(f's.{entity}' if entity.isidentifier() else entity)} AS c0, {high(f's.{entity}' if entity.isidentifier() else entity)} AS c1, {low(local)} AS c2, {high(local)} AS c3 FROM {source} s JOIN {name}_kd k ON ({contig})::BIGINT = k._contig)"
    words = f"{name} AS (SELECT * EXCLUDE (k0, k1, c0, c1, c2, c3), c0::BIGINT AS w0, c1::BIGINT AS w1, c2::BIGINT AS w2, c3::BIGINT AS w3 FROM {name}_out)"
    return ",\n".join([keys, rounds(f"{name}_kd", f"{name}_kq"), body, rounds(f"{name}_out", f"{name}_in"), words])


def uniform(pair: int = 0) -> str:
    return f"(((w{2 * pair + 1} << 21) | (w{2 * pair} >> 11))::DOUBLE * {2.0**-53!r})"


def bounded(width: str) -> str:
    carry = "0::BIGINT"
    for k in range(4):
        carry = f"((w{k} * ({width})::BIGINT + {carry}) >> 32)"
    return carry


def coin(p: str) -> str:
    return f"({p} > 0 AND ({p} >= 1 OR {uniform()} < {p}))"
