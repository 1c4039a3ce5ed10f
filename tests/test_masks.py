"""Calibrated masks, expert mixtures and kernel attention against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import attention as N
from edgeloom.operators import masks as H


def test_directions_are_orthogonal_in_blocks():
    w = N.projections(20, 8, 3)
    for b in (w[:8], w[8:16], w[16:]):
        g = b @ b.T
        assert np.allclose(g - np.diag(np.diag(g)), 0, atol=1e-9)
    assert np.allclose((N.projections(8, 8, 3, True) ** 2).sum(1), 8)
    assert not np.allclose(w[:8] / np.linalg.norm(w[:8], axis=1)[:, None], w[8:16] / np.linalg.norm(w[8:16], axis=1)[:, None])


def test_attention_is_near_the_exact_one(spark):
    rng = np.random.default_rng(2)
    x, v = rng.normal(size=(60, 8)) * 0.8, rng.normal(size=(60, 3))
    rows = [(i, x[i].tolist(), v[i].tolist()) for i in range(60)] + [(60, None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "node long, q array<double>, v array<double>").withColumn("k", F.col("q"))
    got = {r["node"]: r["out"] for r in N.kernel_attention(df, 512, 1).collect()}
    assert set(got) == set(range(60))
    a = np.exp(x @ x.T / math.sqrt(8))
    want = a / a.sum(1)[:, None] @ v
    off = np.abs(np.array([got[i] for i in range(60)]) - want)
    assert off.mean() < 0.05 and off.max() < 0.4
    few = np.abs(np.array([r["out"] for r in N.kernel_attention(df, 16, 1).orderBy("node").collect()]) - want)
    assert off.mean() < few.mean()
    assert N.kernel_attention(df.where("q IS NULL"), 16).count() == 0


@pytest.mark.parametrize("kind", ["ties", "spread", "huge"])
def test_calibration_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "BINS", 4)
    rng = random.Random(kind)
    draw = {"ties": lambda: float(rng.randint(0, 3)), "spread": rng.random, "huge": lambda: rng.choice([1e300, -1e300, 0.0, 1e-300, 1.0])}[kind]
    rows = [(i, draw()) for i in range(120)] + [(200, None)]
    df = spark.createDataFrame(rows, "u long, x double")
    order = [i for i, x in sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))]
    for q in (0, 1, 37, 119, 120, 500):
        assert {r["u"] for r in H.calibrated(df, "x", [F.col("u")], q).collect()} == set(order[:q])


def test_masks_only_shrink(spark):
    rng = random.Random(5)
    edges = [(u, v) for u in range(9) for v in range(u + 1, 9)]
    scores = spark.createDataFrame([(la, u, v, rng.gauss(0, 1) if (u, v) != (0, 1) else None) for la in range(3) for u, v in edges], "layer int, u long, v long, s double")
    thresholds = spark.createDataFrame([(la, n, rng.uniform(-2, 2)) for la in range(3) for n in range(8)], "layer int, node long, t double")
    got = H.layered_masks(scores, thresholds, [30, 17, 40]).collect()
    by = [{(r["u"], r["v"]) for r in got if r["layer"] == la} for la in range(3)]
    assert [len(b) for b in by] == [30, 17, 17] and by[1] <= by[0] and by[2] == by[1] and all((0, 1) not in b for b in by)
    assert all(0 < r["soft"] < 1 for r in got)


def test_gates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0]), (2, [5.0, 5.0, 5.0], [9.0, 9.0, 9.0])], "node long, logits array<double>, spread array<double>")
    still = {r["node"]: r["gates"] for r in H.noisy_gates(df, 3, 2, noise=0.0).collect()}
    assert still[1] == pytest.approx([0, 1 / (1 + math.e), math.e / (1 + math.e)]) and still[2] == pytest.approx([0.5, 0.5, 0])
    a, b, c = ([r["gates"] for r in H.noisy_gates(df, 3, 2, seed=s).orderBy("node").collect()] for s in (1, 1, 2))
    assert a == b != c and all(sum(x > 0 for x in g) == 2 and abs(sum(g) - 1) < 1e-9 for g in a)


def test_hashed_normals_look_normal(spark):
    x = np.array([r[0] for r in spark.range(4000).select(H.hashed_normal("id", seed=3)).collect()])
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.05


def test_mixture(spark):
    rng = random.Random(8)
    edges = [(u, v) for u in range(8) for v in range(8) if u != v and (u * v) % 3 != 1]
    s = {e: [rng.random(), rng.random()] for e in edges}
    gates = {n: [0.25, 0.75] if n % 2 else [1.0, 0.0] for n in range(7)}
    got = H.expert_mixture(
        spark.createDataFrame([(u, v, x) for (u, v), x in s.items()], "src long, dst long, experts array<double>"),
        spark.createDataFrame(list(gates.items()), "node long, gates array<double>"), [0.5, 0.25], 9, gumbel=0.0,
    ).collect()
    soft: dict = {}
    for (u, v), x in s.items():
        mine = [e for e in edges if e[0] == u]
        for e in (0, 1):
            total = sum(math.exp(s[m][e]) for m in mine)
            place = sorted(mine, key=lambda m: (-s[m][e], m[1])).index((u, v)) + 1
            y = gates[u][e] * math.exp(x[e]) / total if u in gates and place <= math.ceil([0.5, 0.25][e] * len(mine)) else 0.0
            k = (min(u, v), max(u, v))
            soft[k] = soft.get(k, 0.0) + y / 2
    want = sorted(soft, key=lambda k: (-soft[k], k))[:9]
    assert {(r["u"], r["v"]) for r in got} == set(want) and all(abs(r["soft"] - soft[r["u"], r["v"]]) < 1e-9 for r in got)
