"""Trees, spanners, growth, swaps, draws and ledgers against plain versions on small graphs."""

import itertools
import random

import numpy as np
import pytest

from edgeloom import session
from edgeloom.operators import balance as B
from edgeloom.operators import cluster as U
from edgeloom.operators import edges as E
from edgeloom.operators import growth as G
from edgeloom.operators import metrics as M
from edgeloom.operators import paths as P
from edgeloom.operators import select as C
from edgeloom.operators import sequential as Q
from edgeloom.operators import tree_score as X
from edgeloom.operators.selectors import REGISTRY, canonical_name, selector
from edgeloom.sources import files
from pyspark.sql import functions as F


def graph(n, m, seed, weighted=False):
    rng = random.Random(seed)
    e = {(i, i + 1) for i in range(n - 1)}
    while len(e) < m:
        a, b = sorted(rng.sample(range(n), 2))
        e.add((a, b))
    return sorted((10 * a, 10 * b, float(rng.randint(1, 4)) if weighted else 1.0) for a, b in e)


def table(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


def reach(rows, root, weighted=True):
    best = {root: 0.0}
    while True:
        moved = False
        for u, v, w in rows:
            for a, b in ((u, v), (v, u)):
                d = best.get(a, np.inf) + (w if weighted else 1)
                if d < best.get(b, np.inf) - 1e-12:
                    best[b], moved = d, True
        if not moved:
            return best


def pairs(df):
    return sorted((r["u"], r["v"]) for r in df.select("u", "v").collect())


def weighted_of(rows, kept):
    w = {(u, v): x for u, v, x in rows}
    return [(u, v, w[u, v]) for u, v in kept]


@pytest.mark.parametrize("stretch,weighted", [(3, False), (3, True), (5, False)])
def test_layered_spanner_keeps_distances(spark, stretch, weighted):
    rows = graph(24, 110, stretch, weighted)
    kept = pairs(U.layered_spanner(table(spark, rows), stretch, 2))
    assert len(set(kept)) == len(kept) < len(rows)
    sub = weighted_of(rows, kept)
    for u, v, w in rows:
        assert reach(sub, u).get(v, np.inf) <= stretch * w + 1e-9
    if not weighted:
        assert sorted(kept) == pairs(U.layered_spanner(table(spark, rows).repartition(5), stretch, 2))


def test_adaptive_spanner_takes_the_nearest_size(spark):
    rows = graph(30, 200, 9)
    e = table(spark, rows)
    sizes = {t: U.layered_spanner(e, t, 1).count() for t in U.STRETCHES[:3]}
    t, s = U.adaptive_spanner(e, sizes[3], 3, 1)
    assert t == 3 and s.count() == sizes[3]
    assert selector("adaptive_spanner")(e, 0.2, 1).count() == 40


def test_greedy_spanner_follows_weights(spark):
    rows = graph(15, 60, 4, True)
    kept = weighted_of(rows, pairs(Q.greedy_spanner(table(spark, rows), 2, 1)))
    for u, v, w in rows:
        assert reach(kept, u).get(v, np.inf) <= 2 * w + 1e-9


@pytest.mark.parametrize("weight", [None, "w"])
def test_random_shortest_forest(spark, weight):
    rows = graph(20, 50, 3, True) + [(1000, 1010, 2.0), (1010, 1020, 1.0), (1000, 1020, 1.0)]
    kept = pairs(G.random_shortest_forest(table(spark, rows), 5, weight))
    assert len(kept) == 19 + 2
    sub = weighted_of(rows, kept)
    roots = [r for r in {x for u, v, _ in rows for x in (u, v)} if all(abs(reach(sub, r, bool(weight)).get(x, np.inf) - d) < 1e-9 for x, d in reach(rows, r, bool(weight)).items())]
    assert any(r < 1000 for r in roots) and any(r >= 1000 for r in roots)


def stretch_of(rows, kept):
    sub = weighted_of(rows, kept)
    far = {u: reach(sub, u) for u in {u for u, _, _ in rows}}
    return sum(far[u][v] / w for u, v, w in rows)


def test_low_stretch_trees(spark):
    rows = graph(12, 26, 7, True)
    e = table(spark, rows)
    greedy, local = pairs(G.greedy_low_stretch(e)), pairs(G.local_low_stretch(e, 50))
    assert len(greedy) == len(local) == 11 and len(reach(weighted_of(rows, local), 0)) == 12
    now = stretch_of(rows, local)
    assert now <= stretch_of(rows, greedy) + 1e-9
    for y, x in itertools.product(local, [r[:2] for r in rows if r[:2] not in local]):  # no exchange is better
        other = [k for k in local if k != y] + [x]
        if len(reach(weighted_of(rows, other), 0)) == 12:
            assert stretch_of(rows, other) >= now - 1e-6
    # the first edge that is joined: single cuts of equal stretch, so the one that the score puts first
    assert len(pairs(G.greedy_low_stretch(table(spark, [(1, 2, 1.0)])))) == 1


def test_lazy_growth(spark):
    rows = [(u, v, 1.0) for u, v, _ in graph(16, 60, 5)] + [(1000 + u, 1000 + v, 1.0) for u, v, _ in graph(10, 20, 6)]
    e = table(spark, rows).withColumn("c", (F.col("u") >= 1000).cast("int"))
    for score in ("log", "joint"):
        s = G.lazy_growth(e, 0.5, score, group="c").collect()
        a, b = [r for r in s if r["u"] < 1000], [r for r in s if r["u"] >= 1000]
        assert len(a) == 30 and len(b) == 10 and len({(r["u"], r["v"]) for r in s}) == 40
        assert len(reach([(r["u"], r["v"], 1.0) for r in a], 0)) == 16
    assert G.lazy_growth(e, 0.5, "log", group="c", add=3).count() == 15 + 3 + 9 + 1
    trace = G.first_step(G.grown_path_trace(table(spark, rows[:60]), [0.3, 0.6], lambda e, ratio: C.top_k(e, F.col("u"), E.budget(e.count(), ratio))))
    assert {r["step"]: r["count"] for r in trace.groupBy("step").count().collect()} == {0: 18, 1: 18}


def test_swaps_end_in_a_local_optimum(spark):
    rows = graph(8, 14, 2)
    e = table(spark, rows)
    start = table(spark, rows[:9])
    kept = set(pairs(Q.swapped(e.select("u", "v"), start.select("u", "v"))))
    assert len(kept) == 9
    u, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    def cost(edges):
        s, lost = Q._scores(u, v, np.ones(len(rows)), {i for i, r in enumerate(rows) if r[:2] in edges}, 1.0, 1.0, 0.0, 2.0, 2.0)
        return sum(s.values()) / max(1, len(s)) + len(lost)

    now = cost(kept)
    for y in kept:
        for x in [r[:2] for r in rows if r[:2] not in kept]:
            assert cost(kept - {y} | {x}) >= now - 1e-9


def test_until_distinct(spark):
    rows = [(i, i + 1, float(1 + i % 5)) for i in range(40)]
    e = table(spark, rows)
    total = sum(w for *_, w in rows)
    p = e.withColumn("p", F.col("w") / total)
    d, draws = C.until_distinct(p, "p", 25, [F.col("u"), F.col("v")], 3)
    got = d.collect()
    assert len(got) == 25 and sum(r["n"] for r in got) == draws
    points = [r["t"] * 1.0 for r in spark.range(draws).select(E.uniform("id", seed=3).alias("t")).collect()]
    cum = np.cumsum([w / total for *_, w in rows])
    hits = [int(np.searchsorted(cum, t, "right")) for t in points]
    assert {rows[h][0] for h in hits} == {r["u"] for r in got} and len({*hits[:-1]}) == 24
    with pytest.raises(ValueError):
        C.until_distinct(p.where("u < 3"), "p", 4, [F.col("u")], 3)


def test_masks_layers_and_pruning(spark):
    e = table(spark, [(i, i + 1, float(i % 7)) for i in range(20)])
    assert C.percentile_pruned(e, 30).count() == 14
    assert C.percentile_pruned(e, 0).count() == 20
    assert pairs(selector("prune_adj")(e, 0.7)) == pairs(C.percentile_pruned(e, 30))
    assert selector("unified_lth")(e, 0.25).count() == 5
    s = e.select("u", "v", F.lit(0).alias("layer"), F.col("w").alias("s")).unionByName(e.select("u", "v", F.lit(1).alias("layer"), F.col("u").cast("double").alias("s")))
    assert selector("adaglt")(e, 0.5, scores=s).count() == 10


def test_names():
    assert canonical_name(" Fast-MaxSF ") == "fast_maxst" and canonical_name("sf") == "maxst" and canonical_name("Rand-SPT") == "rand_spt"
    assert all(canonical_name(a) in REGISTRY for a in ("slsf", "glsf", "llsf", "randspf", "randsf", "minst"))
    forms = [REGISTRY[n] for n in ("glst", "llst", "slst", "randspt", "random_spanning_tree", "support_heap", "support_batch", "joint_dilation_congestion", "tspanner_halperin", "las_vegas_spanner", "effective_resistance", "er_fix")]
    assert len(set(forms)) == len(forms)


def test_bounds_are_refused_not_cut(spark, monkeypatch):
    e = table(spark, graph(10, 15, 1))
    monkeypatch.setattr(X, "TREE_NODES", 3)
    with pytest.raises(ValueError):
        X.forest_arrays(e.limit(2), E.nodes(e))
    monkeypatch.setattr(Q, "MOST_EDGES", 5)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(Q)
    try:
        with pytest.raises(Exception, match="cut it into clusters"):
            Q.sketched_resistance(e, 4).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(Q)


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    with pytest.raises(ValueError):
        session.shared_dir(Session(spark_master="spark://host:7077"))
    assert session.shared_dir(Session(spark_master="local[2]")).startswith("file:///")
    assert session.shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"


def test_artifacts_are_whole(spark, tmp_path):
    e = table(spark, graph(5, 6, 1))
    at = f"file://{tmp_path}/a"
    files.save_artifact(e, at, {"version": 1})
    files.save_artifact(e.limit(2), at, {"version": 2})
    assert files.load_artifact(spark, at, version=2).count() == 2
    # a write that stops before its mark leaves the last one in force
    e.limit(1).write.parquet(f"{at}/data-half")
    assert files.load_artifact(spark, at, version=2).count() == 2
    with pytest.raises(FileNotFoundError):
        files.load_artifact(spark, f"file://{tmp_path}/none")
    files.append_metrics(spark.createDataFrame([("m", 1)], "method string, run int"), f"file://{tmp_path}/l")
    assert len(files.read_metrics(spark, f"file://{tmp_path}/l").columns) == 25
    with pytest.raises(ValueError):
        files.append_metrics(spark.createDataFrame([("m",)], "methode string"), f"file://{tmp_path}/l")


def test_anchors_and_walks(spark):
    line = table(spark, [(i, i + 1, 1.0) for i in range(20)])
    got = [r["node"] for r in P.farthest_anchors(line, 3, 1).orderBy("i").collect()]
    first = got[0]
    assert got[1] == (20 if 20 - first > first else 0) and len(set(got)) == 3
    trail = C.walks(E.adjacency(line.select("u", "v")), E.nodes(line), 3, 1)
    node, edge = C.walk_norms(trail, line)
    seen = {}
    for r in trail.collect():
        seen.setdefault(r["node"], set()).add(r["root"])
    assert {r["node"]: round(r["norm"], 9) for r in node.collect()} == {n: round(21 / len(s), 9) for n, s in seen.items()}
    for r in edge.collect():
        assert abs(r["norm"] - len(seen[r["u"]]) / len(seen[r["u"]] & seen[r["v"]])) < 1e-9


def test_costs_are_the_change_of_the_objective(spark):
    rows = graph(9, 18, 3)
    e = table(spark, rows)
    rng = np.random.default_rng(1)
    f = spark.createDataFrame([(10 * i, [float(x) for x in rng.normal(size=5)]) for i in range(9)], "node long, x array<double>")
    m = B.feature_moments(f, 5, 3, 1)
    t = E.degree(e).select("node", (0.5 * F.col("deg")).alias("target"))
    s = e.limit(0).unionByName(table(spark, rows[:8]))
    state = B.residuals(e, s, t, m)
    before = B.balance_objective(state).first()
    cost = {(r["u"], r["v"]): r["cost"] for r in B.addition_costs(E.missing(e, s), state, m).collect()}
    for row in rows[8:11]:
        after = B.balance_objective(B.residuals(e, table(spark, rows[:8] + [row]), t, m)).first()
        assert abs(sum(after) - sum(before) - cost[row[:2]]) < 1e-9


def test_multi_task_f1_and_load(spark):
    rows = [(0, 1, 0.5), (0, 1, -1.0), (0, 0, 2.0), (0, None, 3.0), (1, -1, 1.0), (2, 0, -1.0), (3, 1, 0.0)]
    r = M.multi_task_f1(spark.createDataFrame(rows, "task int, y int, logit double")).first()
    assert r["tasks"] == 3 and abs(r["f1"] - (2 / 4 + 0 + 1) / 3) < 1e-12
    g = spark.createDataFrame([([0.5, 0.0],), ([0.1, 0.9],)], "gates array<double>")
    assert {x["expert"]: x["load"] for x in M.gate_load(g).collect()} == {0: 2, 1: 1}
    assert M.cv_squared(spark.createDataFrame([(3,)], "load int"), "load").first()[0] == 0.0


def test_low_stretch_trees_of_a_large_cluster(spark):
    """More nodes than a matrix of distances was allowed for: a ring with two hubs, where a tree over the hubs beats one along the ring."""
    n = 4000
    rows = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, n + i % 2, 1.0) for i in range(n)] + [(n, n + 1, 1.0)]
    e = table(spark, rows)
    kept = pairs(G.local_low_stretch(e, 1))
    assert len(kept) == len(pairs(G.greedy_low_stretch(e))) == n + 1
    assert len(reach(weighted_of(rows, kept), 0)) == n + 2


def test_sums_of_a_forest_are_those_of_its_distances():
    rng = np.random.default_rng(4)
    f, edges = G._Forest(30), []
    for x in rng.permutation(29).tolist():
        y, w = int(rng.integers(x + 1)), float(rng.integers(1, 5))
        f.join(x + 1, y, w)
        edges.append((x + 1, y, w))
    ends, share = rng.integers(0, 30, 12).tolist(), rng.random(12).tolist()
    far = {t: reach(edges, t, True) for t in ends}
    got = f.sums(ends, share, f.root[0])
    assert all(abs(got[t] - sum(c * far[s][t] for s, c in zip(ends, share))) < 1e-9 for t in ends)
