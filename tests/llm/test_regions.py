"""Region keys of the LSH forest: keys that rows of two orders share by chance."""

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import minhash


def _block(region, signatures, samples):
    n = len(signatures)
    columns = {"region": [region] * n, "block": [0] * n, "own": [True] * n, "main": [False] * n, "id": list(range(n)), "component": list(range(n)), "n": [len(s) for s in samples]}
    return pa.table(columns | {"signature": [s.tobytes() for s in signatures], "sample": [s.tobytes() for s in samples]})


@pytest.mark.parametrize(("earlier", "expected"), [(False, [(2, 3)]), (True, [])])
def test_a_region_of_rows_from_several_orders(monkeypatch, earlier, expected):
    """All four sets are equal. Rows 0 and 1 have key 7 in orders of their own, rows 2 and 3 in the same, and perhaps share one before it."""
    sample = np.arange(0, 4_000_000, 40_000, dtype=np.uint32)
    signatures = np.tile(np.arange(minhash.HASHES, dtype=np.uint16), (4, 1))
    keys = 100 + np.arange(4 * minhash.TREES, dtype=np.uint64).reshape(4, -1)
    keys[0, 0] = keys[1, 4] = keys[2, 2] = keys[3, 2] = 7
    if earlier:
        keys[2, 1] = keys[3, 1] = 8
    monkeypatch.setattr(minhash, "_keys", lambda s: keys)
    found = minhash._across(0.5, 80)(_block(7, signatures, [sample] * 4))
    assert list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == expected


def test_orders_have_keys_of_their_own():
    """Minima m of one order and the same ones, but for the highest bits of the first, of another."""
    rng = np.random.default_rng(3)
    signatures = np.zeros((2 * 31, minhash.HASHES), np.uint16)
    shared = rng.integers(0, 1 << 11, minhash.DEPTH)
    for t in range(31):
        for row, tree, high in ((2 * t, 0, t + 1), (2 * t + 1, t + 1, 0)):
            signatures[row] = rng.integers(0, 1 << 16, minhash.HASHES)
            signatures[row, minhash.DEPTH * tree : minhash.DEPTH * (tree + 1)] = shared
            signatures[row, minhash.DEPTH * tree] += high << 11
    keys = minhash._keys(signatures)
    assert all(keys[2 * t, 0] != keys[2 * t + 1, t + 1] for t in range(31))
    same = np.tile(rng.integers(0, 1 << 16, minhash.HASHES).astype(np.uint16), (2, 1))
    same[1, minhash.DEPTH :] = 5
    assert (minhash._keys(same)[0] == minhash._keys(same)[1]).tolist() == [True] + [False] * (minhash.TREES - 1)
