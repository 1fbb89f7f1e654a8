"""Clusters of the people of a name."""

import numpy as np
import pytest

from tessera.operators import learning


def plain(distance, cut, size):
    """Average linkage by the definition: clusters as lists of rows."""
    found = [[i] for i in range(len(distance))]
    while len(found) > 1:
        mean = lambda a, b: sum(size[i] * size[j] * distance[i, j] for i in a for j in b) / (size[a].sum() * size[b].sum())
        d, i, j = min((mean(found[i], found[j]), i, j) for i in range(len(found)) for j in range(i + 1, len(found)))
        if d > cut:
            break
        found[i] += found.pop(j)
    return {frozenset(x) for x in found}


def sets(rng, rows, venues, share):
    m = np.unique((rng.random((rows, venues)) < share).astype(np.float32), axis=0)
    return m[m.sum(1) > 0]


def test_agglomerate():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.random((12, 2))
        d, size, cut = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), rng.integers(1, 5, 12), float(rng.uniform(0.05, 1))
        label = learning.agglomerate(d, cut, size)
        assert {frozenset(np.flatnonzero(label == c)) for c in set(label)} == plain(d, cut, size)


@pytest.mark.parametrize("moments", [0, 128])
def test_one_cluster(monkeypatch, moments):
    """What is surely one cluster is one in the matrix, and that is said of many but not of all."""
    monkeypatch.setattr(learning, "MOMENTS", moments)
    rng, said = np.random.default_rng(4), []
    for k in range(150):
        m = sets(rng, 60, 12, rng.uniform(0.2, 0.9))
        if k % 3 == 0:
            m = np.block([[m, np.zeros_like(m)], [np.zeros_like(m[:5]), m[:5]]])  # two groups without a common venue
        n, cut = rng.integers(1, 6, len(m)), float(rng.uniform(0.6, 0.95))
        sure = learning.one_cluster(m, n, cut)
        common = m @ m.T
        whole = learning.agglomerate(1 - common / (m.sum(1)[:, None] + m.sum(1) - common), cut, n)
        assert not sure or len(set(whole)) == 1
        said.append(sure)
    assert 10 < sum(said) < 140


def test_no_matrix(monkeypatch):
    """A large name takes no matrix; before, it took five of all its sets."""
    m = sets(np.random.default_rng(1), 4000, 25, 0.7)
    with monkeypatch.context() as x:
        x.setattr(learning, "agglomerate", None)
        assert (learning.clusters_of_sets(m, np.ones(len(m), int), 0.9) == 0).all()
    assert len(set(learning.agglomerate(1 - (m[:300] @ m[:300].T) / np.maximum(m[:300].sum(1)[:, None] + m[:300].sum(1) - m[:300] @ m[:300].T, 1), 0.9))) == 1
