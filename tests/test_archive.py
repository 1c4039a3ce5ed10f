"""Array archives: slices, pruning, splits and checked resistances."""

import numpy as np
import pytest

from edgeloom.sources import archive as R


@pytest.fixture()
def arrays():
    rng = np.random.default_rng(1)
    e = np.array([(u, v) for u in range(12) for v in range(u + 1, 12) if (u * v + u) % 3 == 0])
    return {"edge_index": e.T.copy(), "x": rng.normal(size=(12, 3)), "y": np.arange(12) % 4, "train_mask": rng.random((12, 2)) < 0.4, "name": np.array([f"n{i}" for i in range(12)])}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("slices, by_column", [(1, False), (5, False), (5, True), (40, True)])
def test_round_trip(spark, tmp_path, arrays, save, slices, by_column):
    path = f"{tmp_path}/g.npz"
    arrays = {k: np.asfortranarray(v) if by_column else v for k, v in arrays.items()}
    save(path, **arrays)
    got = R.read_arrays(spark, path, "node long, y long, x array<double>, train_mask array<boolean>", slices).orderBy("node").collect()
    assert [r["y"] for r in got] == arrays["y"].tolist() and np.allclose([r["x"] for r in got], arrays["x"]) and [r["train_mask"] for r in got] == arrays["train_mask"].tolist()
    edges = R.read_arrays(spark, path, "src long, dst long", slices)
    assert edges.rdd.getNumPartitions() <= slices
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, arrays["edge_index"].T.tolist()))
    every = R.read_arrays(spark, path)
    assert set(every.columns) == {"x", "y", "train_mask", "name"} and every.count() == 12
    assert [r["name"] for r in R.read_arrays(spark, path, "node long, name string", slices).orderBy("node").collect()] == arrays["name"].tolist()


def test_only_what_is_named_is_read(spark, tmp_path, arrays, monkeypatch):
    path = f"{tmp_path}/g.npz"
    np.savez(path, **arrays)
    reader = R.ArrayReader(R.StructType([R.StructField("y", R.LongType())]), path, 3)
    asked = []
    monkeypatch.setattr(R, "rows_of", lambda p, name, a, b, whole=R.rows_of: asked.append((name, a, b)) or whole(p, name, a, b))
    rows = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in rows) == 12 and asked == [("y", 0, 4), ("y", 4, 8), ("y", 8, 12)]


def test_edges_by_rows_and_odd_archives(spark, tmp_path, arrays):
    path = f"{tmp_path}/g.npz"
    np.savez(path, edges=arrays["edge_index"].T, short=np.arange(3), none=np.empty(0, int))
    assert R.read_arrays(spark, path, "src long, dst long").count() == arrays["edge_index"].shape[1]
    assert R.read_arrays(spark, path, "none long").count() == 0
    for schema in ("src long, short long", "what long"):
        with pytest.raises(Exception, match="lengths|no array"):
            R.read_arrays(spark, path, schema).count()
    np.savez(path, odd=np.array([{"a": 1}], object))
    with pytest.raises(ValueError, match="objects"):
        R.shapes(path)


def parts(df):
    return sorted(tuple(r) for r in df.select("split_id", "node", "part").collect())


def test_fixed_splits(spark, tmp_path):
    path = f"{tmp_path}/s.npz"
    np.savez(path, train=np.array([0, 2]), valid=np.array([1]), test=np.array([3, 4, 5]))
    assert parts(R.fixed_splits(spark, path)) == sorted([(0, 0, "train"), (0, 2, "train"), (0, 1, "valid"), (0, 3, "test"), (0, 4, "test"), (0, 5, "test")])
    train = np.array([[1, 0], [0, 1], [0, 0], [0, 0]], bool)
    val, stop, test = np.array([[0, 1], [0, 0], [0, 0], [0, 0]], bool), np.array([[0, 0], [1, 0], [0, 0], [0, 0]], bool), np.array([0, 0, 1, 1], bool)
    np.savez(path, train_mask=train, val_mask=val, stopping_mask=stop, test_mask=test)
    splits = R.fixed_splits(spark, path)
    assert parts(splits) == sorted([(0, 0, "train"), (0, 1, "valid"), (1, 1, "train"), (1, 0, "valid"), *[(s, n, "test") for s in (0, 1) for n in (2, 3)]])
    assert sorted(map(tuple, R.split_for_run(splits, 3).collect())) == sorted([(1, "train"), (0, "valid"), (2, "test"), (3, "test")])
    for bad in ({"train": [0, 1], "valid": [1], "test": [2]}, {"train": [0], "valid": [], "test": [2]}, {"train": [0, 0], "valid": [1], "test": [2]}):
        np.savez(path, **{k: np.array(v, int) for k, v in bad.items()})
        with pytest.raises(ValueError):
            R.fixed_splits(spark, path)


def test_finalised_nodes(spark):
    n = spark.createDataFrame([(0, None), (1, 2), (2, 0)], "node long, y int")
    e = spark.createDataFrame([(0, 1)], "u long, v long")
    assert [tuple(r) for r in R.finalised(n, e).orderBy("node").collect()] == [(0, [pytest.approx(np.log(2))], -1), (1, [pytest.approx(np.log(2))], 2), (2, [0.0], 0)]


def test_resistances_are_checked(spark, tmp_path):
    path = f"{tmp_path}/r.npz"
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "u long, v long")
    good = {"src": [0, 2, 0], "dst": [1, 1, 2], "conductance": [1.0, 2.0, 1.0], "resistance": [0.5, 0.25, 0.5]}
    np.savez(path, **{k: np.array(v) for k, v in good.items()})
    assert sorted(map(tuple, R.resistances(spark, path, e).collect())) == [(0, 1, 1.0, 0.5), (0, 2, 1.0, 0.5), (1, 2, 2.0, 0.5)]
    for change in ({"src": [0, 2, 0], "dst": [1, 1, 1]}, {"conductance": [1.0, 0.0, 1.0]}, {"conductance": [1.0, np.inf, 1.0]}, {"resistance": [0.5, np.nan, 0.5]}, {"src": [0, 2, 0], "dst": [1, 1, 3]}):
        np.savez(path, **{k: np.array(v) for k, v in (good | change).items()})
        with pytest.raises(ValueError, match="fit the graph"):
            R.resistances(spark, path, e)
    np.savez(path, **{k: np.array(v) for k, v in good.items() if k != "resistance"})
    with pytest.raises(ValueError, match="neither"):
        R.resistances(spark, path, e)


def test_cached_split_is_made_once(spark, tmp_path):
    n = spark.createDataFrame([(i, i % 3 - 1) for i in range(30)], "node long, y int")
    a = R.cached_split(n, "s", 1, root=str(tmp_path))
    b = R.cached_split(n, "s", 1, root=str(tmp_path))
    c = R.cached_split(n, "s", 2, root=str(tmp_path))
    assert a.inputFiles() == b.inputFiles() != c.inputFiles() and a.count() == 20


def test_what_is_missing_is_said(spark, tmp_path):
    from edgeloom.sources.files import read_mat

    if __import__("importlib.util").util.find_spec("scipy") is None:
        with pytest.raises(ModuleNotFoundError, match="scipy"):
            read_mat(spark, f"{tmp_path}/m.mat")
