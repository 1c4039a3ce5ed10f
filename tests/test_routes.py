"""Routes that are kept while a graph grows, against a breadth-first search from scratch after each edge."""

import numpy as np
import pytest

from edgeloom.operators.forest import smallest_forest
from edgeloom.operators.routes import AllRoutes, Routes
from edgeloom.operators.sequential import _Graph


def searched(u, v, kept, x):
    g = _Graph(u, v)
    for y in kept:
        g.add(y)
    _, back = g.tree(g.i[x])
    at, inner, links = g.j[x], [], []
    while at != g.i[x]:
        if at not in back:
            return None
        at, e = back[at]
        links.append(e)
        inner.append(at)
    return inner[-2::-1], links[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_routes_stay_right(seed):
    rng = np.random.default_rng(seed)
    pairs = np.unique(np.sort(rng.integers(0, 25, (90, 2)), axis=1), axis=0)
    u, v = pairs[pairs[:, 0] < pairs[:, 1]].T
    m = len(u)
    kept = smallest_forest(u, v, rng.permutation(m)).tolist()
    g = AllRoutes(u, v, kept)
    for x in [None, *rng.permutation(g.rows()).tolist()]:
        if x is not None:
            kept.append(x)
            g.take(x)
        crowd, met = np.zeros(m), np.zeros(len(g.ids))
        for y in g.rows().tolist():
            inner, links = searched(u, v, kept, y)
            n = g.length[y]
            assert g.inner[y, : n - 1].tolist() == inner and g.links[y, :n].tolist() == links
            assert g.route(y) == (inner, links)
            crowd[links] += 1
            met[inner] += 1
        assert (g.crowd[:-1] == crowd).all() and (g.met[:-1] == met).all()


def test_ends_in_two_parts_have_no_route():
    u, v = np.array([1, 2, 4]), np.array([2, 3, 5])
    assert Routes(u, v, [0, 2]).route(1) is None and searched(u, v, [0, 2], 1) is None


@pytest.mark.parametrize("powers", [(1.0, 1.0, 0.0), (0.5, 1.0, 2.0)])
def test_exchanges_cost_what_a_search_from_scratch_says(powers):
    """Each step of the exchanges against all routes searched anew, with edges that alone join their ends and supports in two parts."""
    from edgeloom.operators.sequential import _scores, _Swaps

    rng = np.random.default_rng(5)
    for part in range(6):
        pairs = np.unique(np.sort(rng.integers(0, 9, (30, 2)), axis=1), axis=0)
        u, v = np.concatenate([pairs[pairs[:, 0] < pairs[:, 1]], [[9, 10], [10, 11], [9, 11]], np.array([[8, 9]])[: part % 2]]).T
        m = len(u)

        def cost(kept):
            s, lost = _scores(u, v, np.ones(m), kept, *powers, 2.0, 2.0)
            return sum(s.values()) / max(1, len(s)) + len(lost)

        kept = set(rng.permutation(m)[: (m * 2) // 3].tolist())
        s = _Swaps(u, v, kept, *powers)
        now = s.cost()
        for _ in range(40):
            assert abs(now - cost(s.kept)) < 1e-9
            worst, least = s.order()
            want = next(((x, y) for x in worst for y in least if cost(s.kept - {y} | {x}) < now - 1e-12), None)
            was, without = s.kept, s.without()
            new = next((r for x in worst if (r := s.exchanged(x, least, without, now)) is not None), None)
            if want is None:
                assert new is None and s.kept == was
                break
            assert s.kept == was - {want[1]} | {want[0]}
            now = new


def test_swap_refinement_has_no_bound(spark, monkeypatch):
    from edgeloom.operators import sequential
    from edgeloom.plans import catalogue

    given, whole = [], sequential.swapped
    monkeypatch.setattr(sequential, "swapped", lambda *a, **o: given.append((a, o)) or whole(*a, **o))
    catalogue.QUERIES["swap_refinement"](spark, "/root/testdata/sf0.001").collect()
    assert len(given[0][0]) == 2 and set(given[0][1]) == {"group"}
