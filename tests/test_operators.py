"""Goldens and invariants: forests, scores, components, order, sampling, selectors."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgeloom.functions.scoring import common_neighbours
from edgeloom.operators import cluster, combine, components, edges, forest, select, sequential
from edgeloom.operators.order import average_percentile, running, top
from edgeloom.operators.paths import Forest
from edgeloom.operators.selectors import REGISTRY, selector
from edgeloom.operators.tree_score import path_terms, tree_score
from edgeloom.sources import files, synthetic
from edgeloom.streaming.refresh import Refresher, refresh_epochs

EPS = 1e-8


def table(spark, pairs, w=None):
    return spark.createDataFrame([(u, v, float(w[i] if w else 1)) for i, (u, v) in enumerate(pairs)], "u long, v long, w double")


TREE = [(0, 1), (1, 2), (2, 3), (3, 4)]
EXTRA = [(0, 2), (1, 4), (0, 4)]


def test_score_golden(spark):
    e = table(spark, TREE + EXTRA)
    got = {(r["u"], r["v"]): r for r in tree_score(e, table(spark, TREE)).collect()}
    want = {(0, 2): (2, 2.549510, 2, 0.500000), (1, 4): (3, 2.380476, 2, 0.700275), (0, 4): (4, 2.291288, 2, 0.898717)}
    for k, (dil, ep, vp, score) in want.items():
        assert got[k]["dil"] == pytest.approx(dil) and got[k]["ep"] == pytest.approx(ep, abs=1e-5)
        assert got[k]["vp"] == pytest.approx(vp, abs=1e-5) and got[k]["score"] == pytest.approx(score, abs=1e-5)
    _, f, e_con, v_con = path_terms(e, table(spark, TREE))
    assert dict(zip(f.ids.tolist(), e_con.tolist())) == {0: 0, 1: 2, 2: 3, 3: 2, 4: 2}
    assert {n: int(c) for n, c in zip(f.ids, v_con) if c} == {1: 2, 2: 2, 3: 2}


def test_score_by_enumeration(spark):
    rng = np.random.default_rng(4)
    n = 40
    parent = {i: int(rng.integers(0, i)) for i in range(1, n) if i not in (7, 20)}
    low = [(p, i) for i, p in parent.items()]
    rest = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(120)} - set(low))
    e = table(spark, low + rest)
    got = {(r["u"], r["v"]): r for r in tree_score(e, table(spark, low), p=3, q=1).collect()}

    def up(a):
        out = [a]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    paths = {}
    for u, v in rest:
        a, b = up(u), up(v)
        shared = [x for x in a if x in b]
        if shared:
            paths[u, v] = a[: a.index(shared[0]) + 1] + b[: b.index(shared[0])][::-1]
    ce, cv = {}, {}
    for p in paths.values():
        for x in zip(p, p[1:]):
            ce[tuple(sorted(x))] = ce.get(tuple(sorted(x)), 0) + 1
        for x in p[1:-1]:
            cv[x] = cv.get(x, 0) + 1
    for k in rest:
        r = got[k]
        assert r["mandatory"] == (k not in paths)
        if k in paths:
            p = paths[k]
            es = [ce[tuple(sorted(x))] for x in zip(p, p[1:])]
            assert r["dil"] == len(es)
            assert r["ep"] == pytest.approx((sum((c + EPS) ** 3 for c in es) / (len(es) + EPS)) ** (1 / 3), rel=1e-6)
            assert r["vp"] == pytest.approx(sum(cv[x] + EPS for x in p[1:-1]) / (len(es) - 1 + EPS), rel=1e-6)


def kruskal(pairs, order):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for i in order:
        a, b = root(pairs[i][0]), root(pairs[i][1])
        if a != b:
            up[a] = b
            out.append(pairs[i])
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=80), st.randoms())
def test_smallest_forest_is_kruskals(pairs, rnd):
    pairs = sorted(pairs)
    rank = list(range(len(pairs)))
    rnd.shuffle(rank)
    u, v = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    got = sorted(pairs[i] for i in forest.smallest_forest(u, v, np.array(rank)))
    assert got == kruskal(pairs, np.argsort(rank))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=30, unique=True), st.randoms())
def test_forest_arrays(ids, rnd):
    ids = sorted(ids)
    parent = {b: rnd.choice(ids[: i + 1]) for i, b in enumerate(ids[1:]) if rnd.random() < 0.9}
    f = Forest(np.array(list(parent.values()), int), np.array(list(parent), int), np.array(ids))
    up = lambda x: [x] + (up(int(f.ids[f.parent[f.at(np.array([x]))[0]]])) if f.parent[f.at(np.array([x]))[0]] >= 0 else [])
    for a, b in itertools.product(ids[:8], ids[-8:]):
        l = f.lca(f.at(np.array([a])), f.at(np.array([b])))[0]
        shared = [x for x in up(a) if x in up(b)]
        assert (l < 0 and not shared) or int(f.ids[l]) == shared[0]
    assert sorted(f.tin.tolist()) == list(range(len(ids)))


@pytest.mark.parametrize("finish", [10**6, 10])
def test_components_and_forests_by_contraction(spark, finish):
    rng = np.random.default_rng(1)
    pairs = sorted({tuple(sorted(map(int, rng.choice(300, 2, replace=False)))) for _ in range(260)} | {(i, i + 1) for i in range(400, 470)})
    e = table(spark, pairs)
    got = {r["node"]: r["component"] for r in components.components(e, finish=finish).collect()}
    nodes, low = components.smallest_labels(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert got == dict(zip(nodes.tolist(), low.tolist()))
    order = sorted(range(len(pairs)), key=lambda i: (-(pairs[i][0] * 7 % 13), pairs[i]))
    f = forest.spanning_forest(e.withColumn("s", F.col("u") * 7 % 13), [F.col("s").desc()], finish).select("u", "v").collect()
    assert sorted(map(tuple, f)) == kruskal(pairs, order)
    assert components.components(e.limit(0)).count() == 0 and forest.spanning_forest(e.limit(0), []).count() == 0


def test_strided_forest(spark):
    pairs = [(u, v) for u in range(8) for v in range(u + 1, 8)]
    got = forest.strided_forest(table(spark, pairs), 5, 11).select("u", "v").collect()
    assert sorted(map(tuple, got)) == kruskal(pairs, [(5 + s * 11) % 28 for s in range(28)])


def test_global_order(spark, monkeypatch):
    from edgeloom.operators import order

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("u"), F.lit(1).alias("v"), (F.col("id") % 10).cast("double").alias("x"))
    rows = running(df, [F.col("u")], F.col("x")).orderBy("u").collect()
    assert [r["pos"] for r in rows] == list(range(1, 1001)) and rows[-1]["cum"] == 4500
    monkeypatch.setattr(order, "HEAP_ROWS", 5)
    assert [r["u"] for r in top(df, [F.col("u").desc()], 20).orderBy(F.col("u").desc()).collect()] == list(range(999, 979, -1))
    one = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "s double")
    assert sorted(r["pct"] for r in average_percentile(one, "s").collect()) == [0.25, 0.25, 1.0]
    assert average_percentile(one.limit(1), "s").first()["pct"] == 0.5


def test_budgets():
    assert edges.budget(10, 0.3) == 3 and edges.budget(10, 0.7) == 7 and edges.budget(5, 0.5) == 3
    assert edges.budget(5, 0.5, "round") == 2 and edges.budget(10, 0.01, "round") == 1 and edges.budget(10, 0.39, "floor") == 3


def test_inclusion_and_draw(spark):
    pool = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 1.0)], "u long, v long, w double")
    p = {r["v"]: r["p"] for r in select.inclusion(pool, "w", 2).collect()}
    assert p[1] == 1 and all(p[i] == pytest.approx(1 / 3) for i in (2, 3, 4))
    assert {r["p"] for r in select.inclusion(pool.withColumn("w", F.lit(0.0)), "w", 2).collect()} == {0.5}
    big = spark.range(500).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v"), (F.col("id") % 9 + 1).cast("double").alias("w"))
    q = select.inclusion(big, "w", 120)
    assert q.agg(F.sum("p")).first()[0] == pytest.approx(120)
    for off in (0.01, 0.5, 0.99):
        s = select.systematic(q, "p", 120, off, [F.col("v")])
        assert s.count() == s.select("v").distinct().count() == 120
    assert select.race(big.withColumn("p", F.when(F.col("v") < 450, 0.0).otherwise(1.0)), F.col("p"), 30).where("v < 450").count() == 0
    d = select.with_replacement(big.withColumn("p", F.col("w") / 2500), "p", 5000, [F.col("v")], 3)
    assert d.agg(F.sum("n")).first()[0] in (4999, 5000)


def test_triangles_once_each(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({tuple(sorted(map(int, rng.choice(30, 2, replace=False)))) for _ in range(150)})
    near = {n: {b for a, b in pairs + [p[::-1] for p in pairs] if a == n} for n in range(30)}
    for r in common_neighbours(table(spark, pairs)).collect():
        assert r["common"] == len(near[r["u"]] & near[r["v"]])


def test_resistance_goldens(spark):
    r = sequential.resistance(table(spark, [(1, 2), (1, 3), (2, 3)])).collect()
    assert all(x["resistance"] == pytest.approx(2 / 3) for x in r) and sum(x["resistance"] for x in r) == pytest.approx(2)
    e = synthetic.build(spark, "synth-ringclique-s0")
    exact = {(x["u"], x["v"]): x["resistance"] for x in sequential.resistance(e).collect()}
    sketch = sequential.sketched_resistance(e, 400).collect()
    assert np.mean([abs(x["resistance"] / exact[x["u"], x["v"]] - 1) for x in sketch]) < 0.15


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - {"fixed_support", "support_sequence"}))
def test_selectors_hold_their_contract(spark, name):
    e = synthetic.build(spark, "synth-ringclique6-s0").withColumn("w", (F.col("u") * 3 % 5 + 1).cast("double"))
    out = selector(name.replace("_", "-"))(e, 0.6, 1)
    c = edges.checked(out, e).first()
    assert c["n"] == c["pairs"] > 0 and not c["not_canonical"] and not c["foreign_edges"] and not c["bad_weights"]
    again = selector(name)(e.repartition(3), 0.6, 1)
    assert sorted(map(tuple, again.select("u", "v").collect())) == sorted(map(tuple, out.select("u", "v").collect()))


def test_stored_supports(spark):
    e = table(spark, TREE)
    assert selector("fixed_support")(e, support=e.limit(2)).count() == 2
    with pytest.raises(ValueError):
        selector("fixed_support")(e, support=table(spark, [(0, 9)]))
    views = e.withColumn("view_id", F.col("u") % 2)
    assert selector("support_sequence")(e, seed=3, supports=views).count() == 2
    with pytest.raises(KeyError):
        selector("nonesuch")


def test_flagship_keeps_components(spark):
    e = synthetic.build(spark, "synth-sbm4-s3").withColumn("w", F.lit(1.0))
    m = e.count()
    for q in (edges.budget(m, 0.5), 20):
        out = combine.fast_support(e, q, [F.col("w").desc()])
        assert out.count() == out.distinct().count() == q
    a = components.components(e).agg(F.count_distinct("component")).first()[0]
    kept = combine.fast_support(e, edges.budget(m, 0.5), [F.col("w").desc()])
    assert components.components(kept).agg(F.count_distinct("component")).first()[0] == a


def test_consensus_budget_errors(spark):
    v = table(spark, TREE + EXTRA).withColumn("view_id", F.lit(0))
    with pytest.raises(ValueError):
        combine.consensus(v, 2)
    assert combine.consensus(v, 5).count() == 5


def test_water_filling():
    got = combine.water_filled(np.array([5.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0]), 6.0)
    assert got.sum() == pytest.approx(6) and (got >= 1).all()


def test_owner_of_crossing_edges(spark):
    e = table(spark, [(0, 1), (0, 2), (1, 2), (3, 4), (2, 3)])
    c = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "node long, cluster int")
    assert {(r["u"], r["v"]): r["owner"] for r in cluster.owners(e, c).collect()}[2, 3] == 1
    assert cluster.owners(e, c, "drop").count() == 4


def test_specs():
    assert synthetic.parse_spec("synth-lattice9-s4") == ("grid", 9, 4) and synthetic.parse_spec("theta") == ("theta", 14, 0)
    with pytest.raises(ValueError):
        synthetic.parse_spec("synth-nothing3")


def test_artifacts_and_cache(spark, tmp_path):
    e = table(spark, TREE)
    mark = files.fingerprint(e)
    assert mark == files.fingerprint(e.orderBy(F.col("u").desc())) != files.fingerprint(e.limit(3))
    at = f"file://{tmp_path}/a"
    files.save_artifact(e, at, {"version": 2})
    with pytest.raises(ValueError):
        files.load_artifact(spark, at, version=1)
    built = []
    for _ in range(2):
        assert files.cached(spark, {"g": mark}, lambda: built.append(1) or e, f"file://{tmp_path}/c").count() == 4
    assert built == [1]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "g.npz", edges=np.array([[0, 1, 2], [1, 2, 0]]), node_features=np.eye(3), node_labels=np.array([0, 1, -1]), train_masks=np.array([[True, False, False]]))
    t = files.read_npz(spark, f"file://{tmp_path}/g.npz")
    assert t["edges"].count() == 3 and t["nodes"].where("y = -1").count() == 1 and t["splits"].collect()[0]["part"] == "train"


def test_normal_scaler(spark):
    df = spark.range(999).select(F.col("id").cast("double").alias("a"))
    x = sorted(r["x"][0] for r in files.encode_columns(df, ["a"], scaler="normal").collect())
    assert abs(x[499]) < 1e-3 and x[-1] > 4 and x[int(0.8413 * 999)] == pytest.approx(1, abs=0.02)


def test_refresher(spark):
    assert refresh_epochs(10, 3) == [3, 6, 9] and refresh_epochs(10, 3, True) == [3, 6]
    r = Refresher(lambda v: v * 2)
    assert r.poll() is None and r.launch(4) and not r.launch(5)
    assert r.poll(wait=True) == 8 and r.current == 8 and r.launch(6)
    assert math.isclose(r.poll(wait=True), 12)
