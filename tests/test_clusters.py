"""Modularity clusters and balanced partitions on small graphs."""

import itertools
import random

import pytest

from edgeloom.operators import modularity as Y
from edgeloom.operators import partition as B


def graph(spark, edges):
    return spark.createDataFrame([(u, v, float(w)) for u, v, w in edges], "u long, v long, w double")


def value(edges, of):
    m = sum(w for *_, w in edges)
    inside, k = {}, {}
    for u, v, w in edges:
        k[of[u]] = k.get(of[u], 0) + w
        k[of[v]] = k.get(of[v], 0) + w
        if of[u] == of[v]:
            inside[of[u]] = inside.get(of[u], 0) + w
    return sum(inside.get(c, 0) / m - (x / (2 * m)) ** 2 for c, x in k.items())


def ring_of_cliques(n, size):
    edges = [(c * size + i, c * size + j, 1) for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return edges + [tuple(sorted((c * size, (c + 1) % n * size + 1))) + (1,) for c in range(n)]


def test_cliques_are_found(spark):
    edges = ring_of_cliques(5, 5)
    levels = Y.modularity_levels(graph(spark, edges))
    of = {r["node"]: r["cluster"] for r in levels[-1][0].collect()}
    assert of == {x: x // 5 * 5 for x in range(25)}
    for at, q in levels:
        assert abs(value(edges, {r["node"]: r["cluster"] for r in at.collect()}) - q) < 1e-9
        assert abs(Y.modularity(graph(spark, edges), at).first()["modularity"] - q) < 1e-9
    assert [q for _, q in levels] == sorted(q for _, q in levels)


def partitions(n):
    def grow(prefix, top):
        if len(prefix) == n:
            yield prefix
            return
        for c in range(top + 1):
            yield from grow([*prefix, c], max(top, c + 1))

    return grow([0], 1)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_the_best_of_all_partitions(spark, seed):
    rng = random.Random(seed)
    edges = [(i, j, rng.randint(1, 3)) for i, j in itertools.combinations(range(8), 2) if rng.random() < 0.45]
    names = sorted({x for u, v, _ in edges for x in (u, v)})
    best = max(value(edges, dict(zip(names, p))) for p in partitions(len(names)))
    got = Y.modularity_levels(graph(spark, edges))[-1][1]
    assert 0.75 * best - 0.02 <= got <= best + 1e-12


def test_clusters_of_odd_graphs(spark):
    loops = graph(spark, [(1, 1, 5), (1, 2, 1), (1, 2, 1), (3, 4, 2)])
    assert {(r["node"], r["cluster"]) for r in Y.modularity_clusters(loops).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert Y.modularity_clusters(graph(spark, [])).count() == 0
    assert Y.modularity_clusters(graph(spark, [(7, 7, 1)])).count() == 0


def test_matching_is_one_and_bounded(spark):
    rng = random.Random(2)
    edges = [(i, j, rng.randint(1, 3)) for i, j in itertools.combinations(range(30), 2) if rng.random() < 0.2]
    sizes = spark.createDataFrame([(i, 1 + i % 3) for i in range(30)], "node long, size int")
    up = {r["node"]: r["cluster"] for r in B.matched(graph(spark, edges), sizes, 4, rounds=5).collect()}
    assert set(up) == set(range(30)) and any(a != b for a, b in up.items())
    for c in set(up.values()):
        members = [x for x in up if up[x] == c]
        assert c == min(members) and len(members) <= 2
        if len(members) == 2:
            assert sum(1 + x % 3 for x in members) <= 4 and any({u, v} == set(members) for u, v, _ in edges)


def test_partition_is_balanced_and_cuts_little(spark):
    edges = ring_of_cliques(16, 6)
    g = graph(spark, edges)
    parts = B.balanced_partition(g, 4, 0.1, coarsest=6)
    of = {r["node"]: r["part"] for r in parts.collect()}
    sizes = [list(of.values()).count(p) for p in range(4)]
    assert sum(sizes) == 96 and max(sizes) <= 27
    cut = sum(w for u, v, w in edges if of[u] != of[v])
    assert cut == B.cut_weight(Y.graph_of(g), parts) and cut <= 20  # of 256; four arcs of the ring cut 4


def test_refinement_never_cuts_more(spark):
    rng = random.Random(3)
    edges = [(i, j, 1) for i, j in itertools.combinations(range(40), 2) if rng.random() < 0.15]
    g = Y.graph_of(graph(spark, edges))
    start = spark.createDataFrame([(i, 1, i % 4) for i in range(40)], "node long, size int, part int")
    end = B.refined(g, start, 4, 12)
    assert B.cut_weight(g, end) < B.cut_weight(g, start)
    assert end.groupBy("part").count().agg({"count": "max"}).first()[0] <= 12


def test_parts_of_odd_graphs(spark):
    assert B.balanced_partition(graph(spark, []), 4).count() == 0
    assert {r["part"] for r in B.balanced_partition(graph(spark, [(1, 2, 1), (2, 3, 1)]), 1).collect()} == {0}
    few = B.balanced_partition(graph(spark, [(1, 2, 1), (3, 4, 1)]), 8).collect()
    assert len(few) == 4 and all(0 <= r["part"] < 8 for r in few)
