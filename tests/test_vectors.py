"""Fixed vectors of the generator and the samplers built on it."""

import struct

import numpy as np

from strandlake.functions import philox as rng
from strandlake.functions import samplers


def _words(key, entity, local):
    return [int(x) for x in rng.block(np.uint64(key), np.uint64(entity), np.uint64(local))]


def test_blocks_and_keys():
    assert _words(0, 0, 0) == [0x6627E8D5, 0xE169C58D, 0xBC57AC4C, 0x9B00DBD8]
    assert int(rng.stage_key(0, rng.MUTATION, 0)) == 0x1CD75AC86FB9D4FD
    assert int(rng.stage_key(2**64 - 1, rng.SEQUENCING_ERROR, 2**32 - 1)) == 0x8A25AB3F5A158AA5
    assert int(rng.stage_key(42, rng.QUALITY, 3)) == 0xBA6BDD075C69A508
    assert int(rng.stage_key(0, rng.SITE_STATE, 0)) == 0x98CE57DDCAF9036F
    assert _words(0x98CE57DDCAF9036F, 0, 0) == [0xAD602429, 0x806EAE81, 0x3886458D, 0x5C257F25]


def test_uniform_and_bounded():
    w = tuple(np.array([x], np.uint64) for x in _words(0xBA6BDD075C69A508, 123456789, 987654321))
    assert int(w[0][0]) | int(w[1][0]) << 32 == 0x950984949EDD88A7
    assert int(w[2][0]) | int(w[3][0]) << 32 == 0x6FC075ECEDDC2146
    assert rng.uniform(w)[0] == float.fromhex("0x1.2a1309293dbb1p-1")
    assert samplers.bounded(w, np.array([10]))[0] == 4
    assert samplers.bounded(w, np.array([11]))[0] - 5 == -1


def test_normals():
    args = ((0, 0, 0), (0x0123456789ABCDEF, 17, 2), (2**64 - 1,) * 3)
    got = [struct.pack(">d", float(rng.normal(*(np.array([x], np.uint64) for x in a))[0])).hex() for a in args]
    assert got == ["bfd973628c131c06", "3fb5d995cc23b49b", "bff7a7bdeaf3036d"]


def test_beta_levels():
    for seed, contig, place, a, b, want in ((0, 0, 0, 0.25, 0.75, "3f1ac2f8"), (42, 3, 123456789, 1, 1, "3f72308e"), (12345678901234567890, 20, 2**64 - 1, 2.5, 7.25, "3e8e2d92")):
        key = rng.stage_key(seed, rng.METHYLATION_LEVEL, np.array([contig]))
        assert struct.pack(">f", float(samplers.beta(key, np.array([place], np.uint64), a, b)[0])).hex() == want


def test_insert_lengths():
    key = np.repeat(rng.stage_key(0x123456789ABCDEF0, rng.FRAGMENT, np.array([0])), 12)
    z = rng.normal(key, np.arange(12, dtype=np.uint64), np.zeros(12, np.uint64))
    assert np.clip(400 + np.trunc(25 * z), 100, 1000).astype(int).tolist() == [420, 355, 402, 407, 400, 414, 387, 400, 387, 403, 440, 401]


def test_mutations():
    key = int(rng.stage_key(0x123456789ABCDEF0, rng.MUTATION, np.array([7]))[0])
    u = rng.uniform(rng.block(np.full(32, key, np.uint64), np.arange(32), np.zeros(32)))
    events = samplers.denovo_events(key, np.flatnonzero(u < 0.8), np.array([0, 1, 2, 3] * 8), 0.65, 0.6, False)
    text = ";".join(f"{k}:{a}-{b}:{r or '-'}>{x or '-'}:{m}" for k, a, b, r, x, m in events)
    assert text == (
        "S:0-1:A>C:1;I:2-2:->CT:3;S:3-4:T>A:3;D:6-8:GT>-:3;I:9-9:->G:3;D:10-11:G>-:3;S:12-13:A>C:1;S:13-14:C>T:2;I:15-15:->TG:1;"
        "D:16-19:ACG>-:2;D:19-23:TACG>-:1;D:23-27:TACG>-:3;D:27-30:TAC>-:3;D:30-31:G>-:3;S:31-32:T>C:2"
    )


def test_quality_chain():
    model = {
        "quality_scores": [10, 20, 30],
        "mates": [
            {"initial_counts": [[1, 3, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0]], "transition_counts": [[0, 1, 0], [0, 0, 1], [1, 0, 0]]},
            {"initial_counts": [[0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 0]], "transition_counts": [[0, 0, 1], [1, 0, 0], [0, 1, 0]]},
        ],
    }
    key = rng.stage_key(7, rng.QUALITY, np.array([0]))
    assert samplers.markov_qualities(model, 0, key, np.array([11], np.uint64), 9).tolist() == [[20, 20, 30, 10, 20, 30, 10, 20, 30]]
    assert samplers.markov_qualities(model, 1, key, np.array([11], np.uint64), 8).tolist() == [[30, 10, 20, 30, 10, 30, 20, 10]]
