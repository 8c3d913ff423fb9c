"""numpy samplers on addressed draws: Beta levels, count-weighted rows, quality chains, short mutations."""

from __future__ import annotations

import numpy as np

from . import philox as rng

#: Shape roles sit in the top two bits of the local address: fixed values.
ALPHA, ALPHA_BOOST, BETA, BETA_BOOST = range(4)
MOST_TRIES = 1024


def _address(role: int, offset) -> np.ndarray:
    return np.uint64(role << 62) | np.asarray(offset, np.uint64)


def gamma(key: np.ndarray, entity: np.ndarray, shape: float, role: int) -> np.ndarray:
    """Marsaglia-Tsang: attempt i draws its normal at 2i and its acceptance at 2i + 1; all rows at once,
    those still without a value once more."""
    n = len(entity)
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, todo = np.empty(n), np.arange(n)
    for i in range(MOST_TRIES):
        x = rng.normal(key[todo], entity[todo], np.broadcast_to(_address(role, 2 * i), len(todo)))
        v = (1 + c * x) ** 3
        w = rng.block(key[todo], entity[todo], np.broadcast_to(_address(role, 2 * i + 1), len(todo)))
        u = ((w[1] << np.uint64(21)) | (w[0] >> np.uint64(11))).astype(np.float64)
        u = (u + 1) * 2.0**-53
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(v))
        out[todo[good]] = d * v[good]
        todo = todo[~good]
        if not len(todo):
            break
    else:
        raise ArithmeticError("no gamma draw was accepted")
    if shape < 1:
        w = rng.block(key, entity, np.broadcast_to(_address(role + 1, 0), n))
        u = (((w[1] << np.uint64(21)) | (w[0] >> np.uint64(11))).astype(np.float64) + 1) * 2.0**-53
        out = out * u ** (1 / shape)
    return out


def beta(key: np.ndarray, entity: np.ndarray, a: float, b: float) -> np.ndarray:
    """Beta(a, b) in single precision, as levels are stored."""
    x, y = gamma(key, entity, a, ALPHA), gamma(key, entity, b, BETA)
    if not (x + y > 0).all():
        raise ArithmeticError("both gamma draws of a level are zero")
    return (x / (x + y)).astype(np.float32)


def bounded(w: tuple[np.ndarray, ...], width: np.ndarray) -> np.ndarray:
    carry = np.zeros(len(w[0]), np.uint64)
    for word in w:
        carry = (word * width.astype(np.uint64) + carry) >> np.uint64(32)
    return carry.astype(np.int64)


def weighted(rows: np.ndarray, which: np.ndarray, w: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first column of count row ``which`` whose running count exceeds the draw."""
    upto = np.cumsum(rows, axis=1)
    pick = bounded(w, upto[which, -1])
    return (upto[which] <= pick[:, None]).sum(1)


def markov_qualities(model: dict, mate: int, key: np.ndarray, ordinal: np.ndarray, length: int) -> np.ndarray:
    """[reads, length] quality scores: five initial rows, then a row for each state before.

    The loop runs over cycles; all reads of the batch step together.
    """
    scores, m = np.array(model["quality_scores"]), model["mates"][mate]
    first, step = np.array(m["initial_counts"]), np.array(m["transition_counts"])
    out, state = np.zeros((len(ordinal), length), np.int64), np.zeros(len(ordinal), np.int64)
    for t in range(length):
        w = rng.block(key, ordinal, np.full(len(ordinal), mate << 32 | t))
        state = weighted(first, np.full(len(ordinal), t), w) if t < 5 else weighted(step, state, w)
        out[:, t] = scores[state]
    return out


def confused(model: dict, mate: int, key: np.ndarray, ordinal: np.ndarray, called: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """The bases that a quality's confusion counts make of the called ones (N stays)."""
    scores = np.array(model["quality_scores"])
    rows = np.array(model["mates"][mate]["base_transition_counts"]).reshape(-1, 4)
    place = np.searchsorted(scores, quality)
    if (place >= len(scores)).any() or (scores[place] != quality).any():
        raise ValueError("a quality is not in the confusion model")
    out = called.copy()
    for t in range(called.shape[1]):
        w = rng.block(key, ordinal, np.full(len(ordinal), mate << 32 | t))
        got = weighted(rows, place[:, t] * 4 + np.minimum(called[:, t], 3), w)
        out[:, t] = np.where(called[:, t] < 4, got, 4)
    return out


#: Places that an event can keep from the next ones: a deletion is no longer.
REACH = 4


def restart(positions: np.ndarray, first: int) -> int:
    """The least index from which a scan does not depend on what is before: after a gap that no event reaches over.

    ``first`` is the place from which positions are complete.
    """
    if not len(positions) or first == 0:
        return 0
    gaps = np.flatnonzero(np.diff(positions, prepend=first - 1) > REACH)
    if not len(gaps):
        raise ArithmeticError("mutations are too dense for a tile")
    return int(gaps[0])


def denovo_events(key: int, positions: np.ndarray, bases: np.ndarray, fraction: float, extension: float, homozygous: bool, at: int = 0) -> list[tuple]:
    """(kind, ref_start, ref_end, ref, alt, mask) along one contig.

    ``positions`` are those whose first draw mutates, in order; an accepted event moves the scan on, which
    is why this is a loop.  ``bases`` are the contig's from place ``at`` on (4: N).
    """
    n = len(positions)
    # All draws at once: a contig of few mutations costs one call, not one for each of them.
    locals_ = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 16, 17)
    w = rng.block(np.full(n * len(locals_), key, np.uint64), np.tile(np.asarray(positions, np.uint64), len(locals_)), np.repeat(np.array(locals_, np.uint64), n))
    of = {k: tuple(x[i * n : (i + 1) * n] for x in w) for i, k in enumerate(locals_)}
    u = {k: rng.uniform(of[k]).tolist() for k in (1, 3, 4, 5, 6, 16, 17)}
    snv = bounded(of[2], np.full(n, 3))
    inserted = [bounded(of[8 + k], np.full(n, 4)) for k in range(4)]
    out, free, n = [], 0, len(bases) + at
    for i, pos in enumerate(positions.tolist()):
        if pos < free:
            continue
        mask = 3 if homozygous or u[16][i] < 1 / 3 else 1 if u[17][i] < 0.5 else 2
        ref = int(bases[pos - at])
        if u[1][i] >= fraction:
            out.append(("S", pos, pos + 1, "ACGT"[ref], "ACGT"[(ref + 1 + int(snv[i])) & 3], mask))
            free = pos + 1
            continue
        size = 1
        for k in (4, 5, 6):
            if u[k][i] >= extension:
                break
            size += 1
        if u[3][i] < 0.5:
            end = pos + 1
            while end < min(n, pos + size) and bases[end - at] < 4:
                end += 1
            out.append(("D", pos, end, "".join("ACGT"[b] for b in bases[pos - at : end - at]), "", mask))
            free = end
        else:
            out.append(("I", pos + 1, pos + 1, "", "".join("ACGT"[int(inserted[k][i])] for k in range(size)), mask))
            free = pos + 2
    return out
