"""The balanced completion in pools against rounds over all edges."""

import itertools
import random

import numpy as np
import pytest

from edgeloom.operators import combine as K


def plain(edges, forest, q, batch):
    edges = sorted(edges)
    kept, deg, want = set(forest), {}, {}
    for e in edges:
        for x in e:
            want[x] = want.get(x, 0) + 1
            deg[x] = deg.get(x, 0) + (e in kept)
    ids = sorted(want)
    goal = dict(zip(ids, K.water_filled(np.array([want[x] for x in ids], float), np.array([deg[x] for x in ids], float), 2.0 * q)))
    while len(kept) < q and len(kept) < len(edges):
        gap = {x: goal[x] - deg[x] for x in ids}
        used, left = set(), min(batch, q - len(kept))
        for u, v in sorted((e for e in edges if e not in kept), key=lambda e: (np.round(1 - 2 * gap[e[0]] + 1 - 2 * gap[e[1]], 9), e)):
            if left and u not in used and v not in used:
                used |= {u, v}
                kept.add((u, v))
                deg[u] += 1
                deg[v] += 1
                left -= 1
    return kept


@pytest.mark.parametrize("pool,front", [(20, 8), (60, 200)])
def test_pools_choose_as_all_edges_do(spark, monkeypatch, pool, front):
    monkeypatch.setattr(K, "POOL", pool)
    monkeypatch.setattr(K, "FRONT", front)
    rng = random.Random(pool)
    edges = [(i, j) for i, j in itertools.combinations(range(30), 2) if j == i + 1 or rng.random() < 0.4]
    forest = [(i, i + 1) for i in range(29)]
    t = lambda rows: spark.createDataFrame(rows, "u long, v long")
    q = 100
    got = [tuple(r) for r in K.balanced_completion(t(edges), t(forest), q, 6).collect()]
    assert len(got) == len(set(got)) == q and set(got) == plain(edges, forest, q, 6)
