"""Completion by moments against the sequential rule."""

import itertools
import random

import numpy as np
import pytest

from edgeloom.operators import balance as Q


def small(seed, n=14, m=44, dims=3):
    rng = random.Random(seed)
    edges = sorted(rng.sample(list(itertools.combinations(range(n), 2)), m))
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    forest = []
    for u, v in edges:
        if root(u) != root(v):
            up[root(u)] = root(v)
            forest.append((u, v))
    return edges, forest, {i: [rng.gauss(0, 1) for _ in range(dims)] for i in range(n)}


def plain(edges, forest, q, x, weight, batch):
    names = sorted({a for e in edges for a in e})
    whole = {a: sum(a in e for e in edges) for a in names}
    deg = {a: sum(a in e for e in forest) for a in names}
    low, high = 0.0, 9.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (low, c) if sum(max(deg[a], c * whole[a]) for a in names) > 2 * q else (c, high)
    t = {a: max(deg[a], low * whole[a]) for a in names}
    x = {a: np.array(x[a]) for a in names}
    near = lambda es, a: sum((x[v] if u == a else x[u] for u, v in es if a in (u, v)), np.zeros(3))
    r = {a: near(forest, a) - t[a] * near(edges, a) / whole[a] for a in names}
    kept = list(forest)
    while len(kept) < q:
        part = lambda a, b: (2 * (deg[a] - t[a]) + 1 + weight * float((2 * r[a] * x[b] + x[b] ** 2).sum())) / max(t[a], 1.0) ** 2
        cost = {e: round(part(*e) + part(e[1], e[0]), 9) for e in edges if e not in kept}
        used, new = set(), []
        for e in sorted(cost, key=lambda e: (cost[e], e)):
            if len(new) < min(batch, q - len(kept)) and not used & set(e):
                used |= set(e)
                new.append(e)
        for u, v in new:
            deg[u], deg[v], r[u], r[v] = deg[u] + 1, deg[v] + 1, r[u] + x[v], r[v] + x[u]
        kept += new
    return set(kept), t


@pytest.mark.parametrize("seed, batch, weight", [(1, 3, 1.0), (2, 100, 0.5)])
def test_equals_the_sequential_rule(spark, seed, batch, weight):
    edges, forest, x = small(seed)
    want, t = plain(edges, forest, 28, x, weight, batch)
    union, f = (spark.createDataFrame(e, "u long, v long") for e in (edges, forest))
    targets = {r["node"]: r["target"] for r in Q.degree_targets(union, f, 28).collect()}
    assert targets == pytest.approx(t, abs=1e-6) and sum(targets.values()) == pytest.approx(56)
    log: list = []
    got = Q.completed(union, f, 28, spark.createDataFrame(list(x.items()), "node long, x array<double>"), weight, batch, log)
    assert {(r["u"], r["v"]) for r in got.collect()} == want and set(forest) <= want
    assert log[-1] < log[0]


def test_odd_budgets(spark):
    edges, forest, x = small(3)
    union, f = (spark.createDataFrame(e, "u long, v long") for e in (edges, forest))
    m = spark.createDataFrame(list(x.items()), "node long, x array<double>")
    assert Q.completed(union, f, len(forest), m).count() == len(forest)
    assert Q.completed(union, f, 10_000, m, batch=1000).count() == len(edges)
    with pytest.raises(ValueError):
        Q.completed(union, f, len(forest) - 1, m)
