"""What keeps a job's cost in proportion to its input: steps that are not repeated, and bounds that are gone."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import sequential
from edgeloom.sources import views


@pytest.mark.parametrize("large,small", [(32_768, 4096), (24, 8)])
def test_nearest_with_ties(spark, monkeypatch, large, small):
    """Multiples of a vector have equal cosines up to the last bit; ties go to the smallest ids, also between blocks."""
    monkeypatch.setattr(views, "LARGE", large)
    monkeypatch.setattr(views, "SMALL", small)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    for i in range(30, 90):
        x[i] = x[i % 6] * rng.uniform(0.1, 3)
    x[20] = 0
    nodes = spark.createDataFrame([(int(i), list(map(float, x[i]))) for i in rng.permutation(90)] + [(99, [float("nan")] * 6)], "node long, x array<double>")
    unit = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    c = np.round(unit @ unit.T, 9)
    got = {}
    for r in views.nearest(nodes, 4).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    assert {i: [v for _, v in sorted(n.items())] for i, n in got.items()} == {i: sorted((j for j in range(90) if j != i), key=lambda j: (-c[i, j], j))[:4] for i in range(90)}


def test_the_neighbour_graph_is_searched_once(spark):
    plan = views.knn_graph(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "InArrow" not in plan


def wheel(spark, n):
    """A ring of n nodes and a hub that is next to all of them: 2 n edges."""
    ring = spark.range(1, n + 1).select(F.col("id").alias("u"), F.when(F.col("id") < n, F.col("id") + 1).otherwise(1).alias("v"))
    return ring.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")))


@pytest.mark.parametrize("name,args,size", [("rank_degree", (0.3,), 60_360), ("forest_fire", (0.3,), 60_360), ("uniform_tree", (), 100_600)])
def test_groups_above_the_bound_of_slow_loops(spark, name, args, size):
    assert getattr(sequential, name)(wheel(spark, 100_600), *args).distinct().count() == size


def test_low_stretch_trees_and_spanners_take_time_in_proportion(spark):
    start = time.time()
    e = wheel(spark, 6000).cache()
    assert sequential.low_stretch_tree(e).count() == 6000
    s = sequential.greedy_spanner(e, 3)
    assert 6000 <= s.count() < 12_000
    assert time.time() - start < 60


def test_support_topk_leaves_edges_between_trees_out(spark, monkeypatch):
    """Nodes hang from their smallest neighbours: 1 and 2 are roots, so (1, 4) alone joins their trees and has no score."""
    from edgeloom.plans import catalogue

    pairs = [(1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (3, 5), (4, 6), (6, 7)]
    rows = [(u, v, 1.0) for u, v in pairs]
    monkeypatch.setattr(views, "user_graph", lambda spark, sf: spark.createDataFrame(rows, "u long, v long, w double"))
    low = {(1, 3), (1, 4), (1, 5), (2, 6), (2, 7)}
    assert {tuple(r) for r in catalogue.QUERIES["support_topk"](spark, "").collect()} == low  # the budget of 3 is below the forest
    rows += [(2, 8, 1.0), (3, 8, 1.0), (4, 8, 1.0)] + [(1, x, 1.0) for x in range(10, 20)] + [(2, x, 1.0) for x in range(10, 20)] + [(x, x + 1, 1.0) for x in range(10, 19)]
    rows += [(a, b, 1.0) for a in range(10, 20) for b in range(a + 2, 20)]
    parent: dict = {}
    for u, v, _ in rows:
        parent[v] = min(u, parent.get(v, u))

    def root(x):
        return root(parent[x]) if x in parent else x

    got = [tuple(r) for r in catalogue.QUERIES["support_topk"](spark, "").collect()]
    assert len(got) == len(set(got)) == -(-3 * len(rows) // 10) and all(root(u) == root(v) for u, v in got)


def test_resistance_of_a_graph_above_the_dense_bound(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (90, 2)) if a != b} | {(100, 101), (101, 102)})
    e = spark.createDataFrame([(u, v, float(rng.integers(1, 5))) for u, v in pairs], "u long, v long, w double")
    dense = {(r["u"], r["v"]): r["resistance"] for r in sequential.resistance(e).collect()}
    sparse = {(r["u"], r["v"]): r["resistance"] for r in sequential.resistance(e, most_nodes=10).collect()}
    assert dense.keys() == sparse.keys() and all(abs(dense[k] - sparse[k]) < 1e-10 for k in dense)


def test_a_product_of_blocks_serves_both_directions():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 16))
    x[350:] = x[rng.integers(0, 350, 350)]  # copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = rng.permutation(700)
    c = np.round(x @ x.T, 9)

    def best(rows, among, k):
        return {(int(ids[r]), int(ids[j])) for r in rows for j in sorted((j for j in among if j != r), key=lambda j: (-c[r, j], ids[j]))[:k]}

    for k in (1, 8, 40):
        for one, two in ((range(300), range(300, 700)), (range(4), range(4, 700))):
            got = {}
            for s, d, cos in zip(*views._best(x[one], ids[one], x[two], ids[two], k)):
                got.setdefault(int(s), []).append((-round(float(cos), 9), int(d)))
            assert {(s, d) for s, n in got.items() for _, d in sorted(n)[:k]} == best(one, two, k) | best(two, one, k)


def test_every_pair_of_blocks_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(views, "LARGE", 24)
    monkeypatch.setattr(views, "SMALL", 8)
    nodes = spark.range(200).select(F.col("id").alias("node"), F.array(*[F.rand(i) - 0.5 for i in range(4)]).alias("x"))
    assert "rangepartitioning(pair" in views.nearest(nodes, 4)._jdf.queryExecution().executedPlan().toString()
    assert views.nearest(nodes, 4).count() == 800


@pytest.mark.parametrize("how", ["sum", "mean"])
def test_messages_are_shuffled_whole_and_added_over_batches(spark, how):
    """A hub whose messages fill many batches, and the nodes around it; no message becomes a row for each of its places."""
    from edgeloom.functions.scoring import spread

    rng = np.random.default_rng(7)
    x, n = rng.normal(size=(60, 5)), 60
    pairs = [(i, 0) for i in range(1, n)] + [(0, i) for i in range(1, n)] + [(i, i % 7 + 1) for i in range(8, n)]
    w = rng.uniform(0.5, 2, len(pairs))
    adj = spark.createDataFrame([(a, b, float(c)) for (a, b), c in zip(pairs, w)], "src long, dst long, w double")
    features = spark.createDataFrame([(i, [float(e) for e in x[i]]) for i in range(n)], "node long, x array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = spread(adj, features, how)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r["node"]: r["x"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, total = np.zeros((n, 5)), np.zeros(n)
    for (a, b), c in zip(pairs, w):
        want[b] += c * x[a]
        total[b] += c
    assert sorted(got) == list(range(n))
    for i, row in got.items():
        assert np.allclose(row, want[i] if how == "sum" else want[i] / total[i])
    assert spread(adj.limit(0), features, how).count() == 0


def test_fires_go_on_until_enough_has_burnt(spark):
    """In a dense graph ten fires a node burn few edges: those of the first nodes would fill the rest."""
    rows = [(u, v) for u in range(50) for v in range(u + 1, 50)]
    e = spark.createDataFrame(rows, "u long, v long")
    kept = lambda **o: sorted(map(tuple, sequential.forest_fire(e, 0.3, **o).collect()))
    whole = kept()
    assert len(whole) == 368 and whole == kept(fires=10**9) != kept(fires=500)
    assert kept(burn=0.0) == rows[:368]  # nothing burns, and it ends
    loops = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "u long, v long")
    assert sequential.forest_fire(loops, 0.4).count() == 1
