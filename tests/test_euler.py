"""Tours in tables against walks over a parent array, and scores against the array form."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import euler as U
from edgeloom.operators import tree_score as X
from edgeloom.operators.forest import random_forest


def some_forest(n, trees, seed, chain=False):
    rng = random.Random(seed)
    names = rng.sample(range(10 * n), n)
    parent = {}
    for i in range(n):
        if i >= trees:
            parent[names[i]] = names[i - 1] if chain and i > trees else names[rng.randrange(i)]
    return [tuple(sorted(e)) for e in parent.items()]


def rooted(edges):
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    parent, depth, root = {}, {}, {}
    for r in sorted(near):
        if r in root:
            continue
        parent[r], depth[r], root[r] = None, 0, r
        todo = [r]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if y not in root:
                    parent[y], depth[y], root[y] = x, depth[x] + 1, r
                    todo.append(y)
    return parent, depth, root


def up(x, parent):
    out = [x]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out


@pytest.mark.parametrize("n, trees, chain, block", [(60, 1, False, 256), (90, 4, True, 8)])
def test_tour(spark, monkeypatch, n, trees, chain, block):
    monkeypatch.setattr(U, "ENTRIES", block)
    edges = some_forest(n, trees, n, chain)
    t = U.Tour(spark.createDataFrame(edges, "u long, v long"))
    parent, depth, root = rooted(edges)
    nodes = {r["node"]: r for r in t.nodes.collect()}
    assert {x: (r["parent"], r["depth"], r["root"]) for x, r in nodes.items()} == {x: (parent[x], depth[x], root[x]) for x in parent}
    rng = random.Random(1)
    x = {v: rng.randint(-5, 5) for v in parent}
    values = spark.createDataFrame(list(x.items()), "node long, x long")
    below = {v: sum(x[y] for y in parent if v in up(y, parent)) for v in parent}
    assert {r["node"]: r["total"] for r in t.subtree(values, "x").collect()} == below
    assert {r["node"]: r["total"] for r in t.path(values, "x").collect()} == {v: sum(x[y] for y in up(v, parent)[:-1]) for v in parent}
    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(150)] + [(-1, edges[0][0])]
    pairs = sorted(set(pairs))
    got = {(r["u"], r["v"]): r["lca"] for r in t.ancestors(spark.createDataFrame(pairs, "u long, v long")).collect()}
    for u, v in pairs:
        both = [y for y in up(u, parent) if y in up(v, parent)] if u in parent else []
        assert got[u, v] == (both[0] if both else None)


def test_terms_equal_the_arrays(spark, monkeypatch):
    monkeypatch.setattr(U, "ENTRIES", 16)
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(50), 2))) for _ in range(160)} | {(60, 61), (61, 62), (60, 62)})
    e = spark.createDataFrame([(u, v, float(rng.randint(1, 5))) for u, v in pairs], "u long, v long, w double")
    f = random_forest(e, 2).select("u", "v")
    held = X.tree_score(e, f, beta_v=1.0, weight="w").orderBy("u", "v").collect()
    monkeypatch.setattr(X, "TREE_NODES", 3)
    table = X.tree_score(e, f, beta_v=1.0, weight="w").orderBy("u", "v").collect()
    assert len(held) == len(table) > 50
    for a, b in zip(held, table):
        assert a[:3] == b[:3] and a["mandatory"] == b["mandatory"]
        for c in ("dil", "ep", "vp", "score"):
            assert (a[c] is None and b[c] is None) or a[c] == pytest.approx(b[c], rel=1e-7, abs=1e-9)


def test_a_forest_that_is_not_whole_leaves_edges_mandatory(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (2, 3), (7, 8)], "u long, v long")
    f = e.where("v <> 8 AND NOT (u = 0 AND v = 2) AND NOT (u = 2 AND v = 3)")
    got = {(r["u"], r["v"]): r["mandatory"] for r in U.path_terms(e, f).collect()}
    assert got == {(0, 2): False, (2, 3): True, (7, 8): True}
    assert U.path_terms(f, f).count() == 0
