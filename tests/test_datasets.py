"""Datasets by name, the retrieval task, candidates, kept supports and frozen re-ranking, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import combine, paths, select
from edgeloom.sources import datasets, files


def graph(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (3 * n, 2)) if a != b}
    return spark.createDataFrame(sorted(pairs), "u long, v long"), sorted(pairs)


def saved(spark, root, name, y="int", splits=None):
    spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2), (3, 4), (4, 5)], "src long, dst long").write.parquet(f"{root}/{name}/edges")
    rows = [(i, [i % 2 * 1.0, 1.0] if y == "flags" else (i % 3 if i else None)) for i in range(40)]
    spark.createDataFrame(rows, "node long, y " + ("array<double>" if y == "flags" else "int")).write.parquet(f"{root}/{name}/nodes")
    if splits:
        spark.createDataFrame(splits, "split_id int, node long, part string").write.parquet(f"{root}/{name}/splits")


def parts(d):
    return {(r["split_id"], r["node"]): r["part"] for r in d.splits.collect()}


def test_names():
    assert datasets.canonical_name(" Karate_Balanced ") == "karate-balance" and datasets.canonical_name("arxiv") == "ogbn-arxiv"
    assert set(datasets.ALIASES.values()) <= set(datasets.NAMES)


def test_protocols(spark, tmp_path):
    given = [(0, 1, "train"), (0, 2, "valid"), (0, 3, "test"), (1, 1, "test"), (1, 2, "train"), (1, 3, "valid")]
    saved(spark, tmp_path, "texas", splits=given)
    d = datasets.load_dataset(spark, str(tmp_path), "Texas")
    assert parts(d) == {(s, n): p for s, n, p in given} and d.classes == 3 and not d.multilabel
    assert sorted(map(tuple, d.edges.collect())) == [(0, 1), (1, 2), (3, 4), (4, 5)]
    x = {r["node"]: (r["x"], r["y"]) for r in d.nodes.collect()}
    assert x[0][1] == -1 and x[39][0] == [0.0] and x[5][1] == 2  # a node without edges has a feature too
    r = datasets.load_dataset(spark, str(tmp_path), "texas", split_protocol="random", train_ratio=0.6, valid_ratio=0.2)
    again = datasets.load_dataset(spark, str(tmp_path), "texas", split_protocol="random", train_ratio=0.6, valid_ratio=0.2)
    assert parts(r) == parts(again) and r.splits.inputFiles() == again.splits.inputFiles()
    got = list(parts(r).values())
    assert [got.count(p) for p in ("train", "valid", "test")] == [23, 7, 9]  # the node without a label is in none
    np.savez(f"{tmp_path}/texas_split.npz", train=np.array([4, 5]), valid=np.array([6]), test=np.array([7, 8]))
    fixed = parts(datasets.load_dataset(spark, str(tmp_path), "texas"))
    assert fixed == {(0, 4): "train", (0, 5): "train", (0, 6): "valid", (0, 7): "test", (0, 8): "test"}


def test_class_rules_flags_and_builders(spark, tmp_path):
    saved(spark, tmp_path, "karate-balance")
    d = datasets.load_dataset(spark, str(tmp_path), "karate_balance")
    by = d.splits.join(d.nodes, "node").where("part = 'train'").groupBy("y").count().collect()
    assert {r["count"] for r in by} == {3} and len(by) == 3
    saved(spark, tmp_path, "ogbn-proteins", y="flags")
    m = datasets.load_dataset(spark, str(tmp_path), "proteins")
    assert m.multilabel and m.classes == 2 and m.splits.count() == 40
    e, _ = graph(spark)
    datasets.register("my graph", lambda s: (s.range(60).toDF("node"), e, None))
    try:
        b = datasets.load_dataset(spark, str(tmp_path), "My Graph", split_protocol="native")
        assert b.classes == 0 and b.splits.count() == 0  # nothing is labelled
    finally:
        datasets.BUILDERS.clear()


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown"):
        datasets.load_dataset(spark, str(tmp_path), "nothing")
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, str(tmp_path), "cora")
    with pytest.raises(ValueError, match="protocol"):
        datasets.load_dataset(spark, str(tmp_path), "cora", split_protocol="mine")
    saved(spark, tmp_path, "cornell", splits=[(0, 1, "train"), (0, 1, "test")])
    with pytest.raises(ValueError, match="twice"):
        datasets.load_dataset(spark, str(tmp_path), "cornell")


def test_retrieval_task(spark):
    e, pairs = graph(spark)
    rows = {r["node"]: r for r in paths.keyed_retrieval_task(e, 7, 3).collect()}
    assert set(rows) == {x for p in pairs for x in p}
    sources = {n: r for n, r in rows.items() if r["y"] == -1}
    assert len(sources) == 7 and sorted(r["x"].index(10.0) for r in sources.values()) == list(range(7))
    for n, r in rows.items():
        assert len(r["x"]) == 15
        if n in sources:
            assert abs(r["x"][7]) == 10.0 and r["asked"] is None and not any(r["x"][8:])
        else:
            s = sources[r["asked"]]
            assert not any(r["x"][:8]) and r["x"][8 + s["x"].index(10.0)] == 10.0 and r["y"] == (s["x"][7] > 0)
    tiny = paths.keyed_retrieval_task(spark.createDataFrame([(1, 2)], "u long, v long"), 15).collect()
    assert sorted(r["y"] == -1 for r in tiny) == [False, True]
    assert paths.keyed_retrieval_task(e.where("false")).count() == 0


def test_candidates(spark):
    e, pairs = graph(spark)
    kept, rest = e.where("u % 3 = 0"), e.where("u % 3 <> 0")
    n = rest.count()
    assert select.candidate_sample(kept, rest, 5, "full").count() == n
    assert select.candidate_sample(kept, rest, 0).count() == 1 and select.candidate_sample(kept, rest, 10 * n, "weighted").count() == n
    hub = spark.createDataFrame([(0, i) for i in range(1, 200)], "u long, v long")
    c = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, i + 1000) for i in range(300, 360)], "u long, v long")
    got = [r["u"] for s in range(3) for r in select.candidate_sample(hub, c, 40, "weighted", s).collect()]
    assert sum(u > 0 for u in got) > sum(u == 0 for u in got)  # 2 against about 1 in weight
    with pytest.raises(ValueError):
        select.candidate_sample(kept, rest, 5, "best")


def test_consensus_artifact(spark, tmp_path):
    e, pairs = graph(spark)
    files.save_consensus(e, f"{tmp_path}/a", method="x")
    assert sorted(map(tuple, files.load_consensus(spark, f"{tmp_path}/a").collect())) == pairs
    files.save_consensus(e.limit(0), f"{tmp_path}/b")
    assert files.load_consensus(spark, f"{tmp_path}/b").count() == 0
    for name, bad in (("c", e.unionByName(e.limit(1))), ("d", e.select(F.col("v").alias("u"), F.col("u").alias("v")))):
        files.save_consensus(bad, f"{tmp_path}/{name}")
        with pytest.raises(ValueError):
            files.load_consensus(spark, f"{tmp_path}/{name}")
    files.save_consensus(e, f"{tmp_path}/f", num_nodes=5)
    with pytest.raises(ValueError, match="outside"):
        files.load_consensus(spark, f"{tmp_path}/f")


def test_frozen_model(spark, monkeypatch):
    rng = np.random.default_rng(5)
    e, pairs = graph(spark)
    x, y, c = rng.normal(size=(60, 4)), rng.integers(-1, 3, 60), rng.normal(size=(3, 4))
    nodes = spark.createDataFrame([(i, list(map(float, x[i])), int(y[i])) for i in range(60)], "node long, x array<double>, y int")
    model = spark.createDataFrame([(i, list(map(float, c[i]))) for i in range(3)], "label int, c array<double>")
    views = e.withColumn("view_id", F.lit(0)).unionByName(e.where("u % 2 = 0").withColumn("view_id", F.lit(1))).unionByName(e.where("u < 9").withColumn("view_id", F.lit(2)))
    got = {r["view_id"]: (r["accuracy"], r["rank"]) for r in combine.reranked(views, nodes, model).collect()}
    want = {}
    for i, keep in enumerate((lambda u: True, lambda u: u % 2 == 0, lambda u: u < 9)):
        a = np.eye(60)
        for u, v in pairs:
            if keep(u):
                a[u, v] = a[v, u] = 1
        pred = ((a / a.sum(1, keepdims=True)) @ x @ c.T).argmax(1)
        want[i] = round(float((pred == y)[y >= 0].mean()), 9)
    order = sorted(want, key=lambda i: (-want[i], i))
    assert got == {i: (want[i], order.index(i) + 1) for i in want}
    monkeypatch.setattr(combine, "ROWS", 2)
    with pytest.raises(ValueError):
        combine.reranked(views, nodes, model)


@pytest.mark.parametrize("block", [4096, 16])
def test_squared_neighbours(spark, monkeypatch, block):
    from edgeloom.sources import views

    monkeypatch.setattr(views, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(70, 3)), 1)
    x[10:14] = x[9]  # equal vectors
    y = [None if i % 7 == 0 else i % 2 for i in range(70)]
    nodes = spark.createDataFrame([(i, list(map(float, x[i])), y[i]) for i in range(70)], "node long, x array<double>, y int")
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 9)
    order = lambda i, among: sorted(among, key=lambda j: (d[i, j], j))
    got = {}
    for r in views.nearest_squared(nodes, 5, 2, batch="y").collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    assert all([v for _, v in sorted(got[i].items())] == order(i, [j for j in range(70) if y[j] == y[i]])[:10:2] for i in range(70))
    near = {}
    for r in views.nearest_squared(nodes, 4, 3, seed=1).orderBy("src", "rank").collect():
        near.setdefault(r["src"], []).append(r["dst"])
    for i, some in near.items():
        assert len(some) == 4 and set(some) <= set(order(i, range(70))[:12]) and some == order(i, some)
    assert len(near) == 70 and views.nearest_squared(nodes.limit(0)).count() == 0


def test_a_kept_stretch(spark, tmp_path, monkeypatch):
    from edgeloom.operators import cluster

    e, _ = graph(spark)
    one, first = cluster.tuned_spanner(e, 70, seed=2, name="g", root=str(tmp_path))
    assert (one, sorted(map(tuple, first.collect()))) == (lambda t, s: (t, sorted(map(tuple, s.collect()))))(*cluster.adaptive_spanner(e, 70, seed=2))
    monkeypatch.setattr(cluster, "adaptive_spanner", None)  # what was chosen is not chosen again
    two, again = cluster.tuned_spanner(e, 70, seed=2, name="g", root=str(tmp_path))
    assert two == one and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    with pytest.raises(TypeError):  # another graph is tuned anew
        cluster.tuned_spanner(e.limit(50), 70, seed=2, name="g", root=str(tmp_path))
