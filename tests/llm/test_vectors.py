"""Near-duplicate vectors and exact Hamming search against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from edgeloom.llm import embed_dups, hamming_topk
from edgeloom.llm.embed_dups import near_duplicates
from edgeloom.llm.hamming_topk import search, sign_bits, top_k


def clusters(seed, n=700, d=32, near=0.25):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(1, n):
        if rng.random() < 0.5:
            x[i] = x[rng.integers(i)] + rng.normal(size=d) * near * rng.random()
        if rng.random() < 0.05:
            x[i] = x[rng.integers(i)]
    return x.astype(np.float32)


def brute(ids, x, least=0.9):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    up = list(range(len(x)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        up[root(a)] = root(b)
    low = defaultdict(lambda: 1 << 60)
    for i in range(len(x)):
        low[root(i)] = min(low[root(i)], ids[i])
    return {ids[i]: (int(near[i].sum()), low[root(i)]) for i in range(len(x))}


@pytest.mark.parametrize("part", [16_000, 60])
def test_links_and_components(spark, monkeypatch, part):
    monkeypatch.setattr(embed_dups, "PART", part)
    x = clusters(1)
    ids = [int(i) for i in np.random.default_rng(0).permutation(5000)[: len(x)]]
    out = near_duplicates(spark.createDataFrame([(i, r.tolist(), 0) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, n_links int")).collect()
    want = brute(ids, x)
    found = sum(r["n_links"] for r in out)
    assert found >= 0.99 * sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in out)
    assert sum(r["component_id"] == want[r["vec_id"]][1] for r in out) >= 0.99 * len(out)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_large_inputs_keep_the_width_of_tables(spark, monkeypatch):
    widths = []

    def seen(bits, width, tables):
        widths.append(width)
        raise StopIteration

    monkeypatch.setattr(embed_dups, "picks", seen)
    rows = spark.range(200_001).selectExpr("id as vec_id", "transform(sequence(1, 16), i -> float(hash(id, i))) as embedding")
    for n in (100, 200_001):
        with pytest.raises(StopIteration):
            near_duplicates(rows.where(f"vec_id < {n}"))
    assert widths == [12, 12]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [nan] + [1.0] * 7), (5, [inf] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, [1.0] * 8), (8, [2.0] * 8), (9, [1.0] * 8), (10, [1.0] * 4), (11, [-1.0] * 8), (9, [1.0] * 8), (None, [1.0] * 8)]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = sorted(((-1 if r[0] is None else r[0]), r[1], r[2], r[3]) for r in out)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)]
    same = [(7, 4, 7, True), (8, 4, 7, False), (9, 4, 7, False), (9, 4, 7, False)]
    assert [g for g in got if g[0] > 0] == sorted(alone + same) and got[0][1:3] == (4, 7)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    none = near_duplicates(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert [r["n_links"] for r in none] == [0, 0, 0]


@pytest.mark.parametrize("bits,n,k", [(64, 400, 10), (16, 300, 7), (70, 200, 5), (8, 500, 20), (64, 6, 10)])
def test_search_is_exact(bits, n, k):
    rng = np.random.default_rng(bits + n)
    b = rng.random((n, bits)) < 0.5
    b[n // 2 :] = b[: n - n // 2] ^ (rng.random((n - n // 2, bits)) < 0.1)
    words = hamming_topk.packed(b)
    codes, group = np.unique(words, axis=0, return_inverse=True)
    weight = np.minimum(np.bincount(group.reshape(-1)), k)
    asked = rng.random((40, bits)) < 0.5
    q, c, d = search(codes, hamming_topk.packed(asked), bits, k, weight)
    true = (asked[:, None] ^ b[None]).sum(2)
    for i in range(40):
        got = np.sort(np.repeat(d[q == i], weight[c[q == i]]))[:k]
        assert (got == np.sort(true[i])[:k]).all()


def test_top_k_rows(spark, monkeypatch):
    monkeypatch.setattr(hamming_topk, "INDEX_ROWS", 40)
    monkeypatch.setattr(hamming_topk, "QUERY_ROWS", 3)
    x = clusters(5, 200, 24)
    x[50:120] = x[7]  # one very common vector
    rows = [(i, r.tolist(), "x") for i, r in enumerate(x)] + [(900, None, ""), (901, [], ""), (920, [None] * 24, ""), (902, [1.0] * 5, ""), (940, [1.0] * 5, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").select("vec_id", sign_bits().alias("bits"), "rank")
    out = top_k(df, df.where("vec_id % 20 = 0"), 10).collect()
    b = x > 0
    want = []
    for i in range(0, 200, 20):
        d = sorted(((b[i] ^ b[j]).sum(), j) for j in range(200))[:10]
        want += [(i, r + 1, j, int(n)) for r, (n, j) in enumerate(d)]
    want += [(940, 1, 902, 0), (940, 2, 940, 0)]
    assert sorted(map(tuple, out)) == sorted(want)
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0
