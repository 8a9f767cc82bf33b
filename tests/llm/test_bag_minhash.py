"""BagMinHash: how points of the processes are drawn."""

import numpy as np
import pytest

from folioscope.llm import bag_minhash


@pytest.mark.parametrize("n", [12, 300, 5000])
def test_points_are_drawn_in_few_rounds(monkeypatch, n):
    rounds = []
    drawn = np.cumsum
    monkeypatch.setattr(bag_minhash.np, "cumsum", lambda *a, **k: rounds.append(1) or drawn(*a, **k))
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    assert len(bag_minhash.signature(hashes)) == 120
    assert len(rounds) <= 5


def test_times_do_not_depend_on_rounds(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [np.repeat(rng.integers(0, 1 << 63, k).astype(np.uint64), rng.integers(1, c, k)) for k in (1, 7, 60) for c in (2, 9, 300)]
    want = [bag_minhash.signature(t).tolist() for t in texts]
    monkeypatch.setattr(bag_minhash.math, "sqrt", lambda x: 0.0)  # shorter chunks
    assert [bag_minhash.signature(t).tolist() for t in texts] == want
