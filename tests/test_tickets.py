"""Lottery tickets and alternating directions: they end, keep the budget, and equal plain loops."""

import random

import pytest

from edgeloom.operators import edges as E
from edgeloom.operators import tickets as H
from edgeloom.operators.selectors import selector


def graph(spark, m, seed=0):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(3 * m)})
    return [(u, v, float(rng.randint(1, 9))) for u, v in rng.sample(pairs, m)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


def plain(rows, q, rate):
    left = list(rows)
    while len(left) > q:
        n = max(q, len(left) - max(1, int(rate * len(left))))
        deg: dict = {}
        for u, v, _ in left:
            deg[u], deg[v] = deg.get(u, 0) + 1, deg.get(v, 0) + 1
        left = sorted(left, key=lambda e: (-(e[2] / (deg[e[0]] * deg[e[1]]) ** 0.5), e[0], e[1]))[:n]
    return {e[:2] for e in left}


# sizes where ratio * m is a whole number and where it is not
@pytest.mark.parametrize("m, ratio", [(100, 0.3), (112, 0.3), (51, 0.4), (7, 0.5), (3, 0.01), (5, 1.0)])
def test_rounds_end_at_the_budget(spark, m, ratio):
    rows = graph(spark, m)
    q = E.budget(m, ratio)
    got = {(r["u"], r["v"]) for r in selector("unified_lth")(frame(spark, rows), ratio, rate=0.4).collect()}
    assert len(got) == q and got == plain(rows, q, 0.4)


def test_rounds_differ_from_one_cut(spark):
    """A hub's edges score low until its other edges are gone."""
    rows = [(0, i, 2.5) for i in range(1, 10)] + [(20 + i, 30 + i, 1.0 + i / 100) for i in range(6)]
    one = {(r["u"], r["v"]) for r in H.lottery(frame(spark, rows), 6, 1.0).collect()}
    many = {(r["u"], r["v"]) for r in H.lottery(frame(spark, rows), 6, 0.1).collect()}
    assert one == plain(rows, 6, 1.0) and many == plain(rows, 6, 0.1) and one != many


def test_alternating_directions(spark):
    rows = graph(spark, 30, 3)
    s = {e[:2]: e[2] for e in rows}
    w, d = dict(s), dict.fromkeys(s, 0.0)
    for _ in range(5):
        best = set(sorted(s, key=lambda e: (-abs(w[e] + d[e]), e))[:9])
        z = {e: w[e] + d[e] if e in best else 0.0 for e in s}
        d = {e: d[e] + w[e] - z[e] for e in s}
        w = {e: (s[e] + 0.5 * (z[e] - d[e])) / 1.5 for e in s}
    want = set(sorted(s, key=lambda e: (-abs(w[e]), e))[:9])
    assert {(r["u"], r["v"]) for r in H.admm(frame(spark, rows), 9, 0.5, 5).collect()} == want


def test_odd_tables(spark):
    assert H.lottery(frame(spark, []), 0).count() == 0 and H.admm(frame(spark, []), 3, rounds=1).count() == 0
    assert H.lottery(frame(spark, [(1, 2, None), (2, 3, -5.0)]), 1).first()["v"] == 3
