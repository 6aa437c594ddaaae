"""The pipeline's near copies come from SimHash fingerprints."""

from __future__ import annotations

import numpy as np

from tallywright.llm import near_copies


def test_bits_are_the_majority_of_the_hashes():
    cells = np.random.default_rng(3).integers(1 << 63, size=601, dtype=np.uint64)
    bits = near_copies.simhash_bits(cells, 200)
    hashes = near_copies._mixed(cells[:, None] ^ near_copies._SALTS[:4])
    votes = np.unpackbits(hashes.view(np.uint8), axis=1).astype(int).sum(0)[:200]
    assert (bits == (2 * votes > 601)).all()


def test_pairs_at_the_limit_share_a_key_and_are_close_but_unrelated_ones_are_not():
    rng = np.random.default_rng(4)
    size, n = near_copies.shape(200_000)
    shared = far = 0
    for _ in range(300):
        both, a, b, c = (rng.integers(1 << 63, size=k, dtype=np.uint64) for k in (160, 20, 20, 180))
        (da, ka), (db, kb), (dc, _) = (near_copies.keys(x, size, n) for x in (np.concatenate([both, a]), np.concatenate([both, b]), c))
        distance = lambda x, y: int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum())
        shared += bool((ka == kb).any()) and distance(da, db) <= near_copies.NEAR_BITS
        far += distance(da, dc) > near_copies.NEAR_BITS
    assert shared == 300 and far >= 298


def test_each_text_with_another_close_by_is_found_in_a_crowded_bucket():
    rng = np.random.default_rng(5)
    s = rng.integers(-(1 << 63), 1 << 63, size=(2, 900), dtype=np.int64, endpoint=False)
    s[:, 100:700] = s[:, :1]  # a large group
    s[0, 800], s[1, 800] = s[0, 801], s[1, 801]
    bits = np.unpackbits(np.ascontiguousarray(s.T).view(np.uint8), axis=1)
    near = ((bits[:, None] != bits[None]).sum(2) <= near_copies.NEAR_BITS) & ~np.eye(900, dtype=bool)
    mine, others = near_copies.partners(list(s))
    assert set(mine.tolist()) | set(others.tolist()) == set(np.flatnonzero(near.any(1)).tolist())
    assert near[mine, others].all() and len(mine) <= 900
    root = np.arange(900)
    root[100:650] = 0
    want = (near & (root[:, None] != root)).any(1)
    assert sorted(near_copies.apart(root, list(s)).tolist()) == np.flatnonzero(want).tolist()
