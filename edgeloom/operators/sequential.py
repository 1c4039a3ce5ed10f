"""Selectors whose steps depend on each other, for graphs (or clusters) of bounded size.

Each runs in one Arrow task per group, so many clusters run side by side; a group above MOST_EDGES is
refused, as a loop over it would not end in useful time. Loops whose time grows as their edges do go up to
LONG_EDGES, which is a bound of memory. Random choices are in hash order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scoring import EPS
from edgeloom.operators.components import smallest_labels
from edgeloom.operators.routes import FAR, AllRoutes, Routes
from edgeloom.session import stored

#: The size bound of a group.
MOST_EDGES = 200_000
#: The same for loops that take time in proportion to their edges.
LONG_EDGES = 4_000_000
#: Tasks that groups are dealt to: small partitions would be put together, though a loop over each is long.
TASKS = 64


def grouped(edges: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], group: str | None = None, most: int | None = None) -> DataFrame:
    """Edges that ``work(u, v, w)`` keeps (a mask or places) of each group of at most ``most`` edges (MOST_EDGES), given in ascending (u, v) order."""
    most = MOST_EDGES if most is None else most
    g = edges.withColumn("__g", F.col(group) if group else F.lit(0)).withColumn("__w", F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0))

    def run(t: pa.Table) -> pa.Table:
        if len(t) > most:
            raise ValueError(f"a group of {len(t)} edges; cut it into clusters of {most} at most")
        t = t.sort_by([("u", "ascending"), ("v", "ascending")])
        u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "__w"))
        kept = np.sort(np.arange(len(u))[work(u, v, w)])
        return pa.table([u[kept], v[kept]], ["u", "v"])

    return g.select("u", "v", "__w", "__g").repartition(TASKS, "__g").groupBy("__g").applyInArrow(run, "u long, v long")


def _hash_order(u: np.ndarray, v: np.ndarray, seed: int) -> np.ndarray:
    return np.array(sorted(range(len(u)), key=lambda i: hashlib.md5(f"{seed}|{u[i]}|{v[i]}".encode()).digest()), int)


class _Graph:
    """Neighbour lists over places 0..n-1."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.ids, e = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.i, self.j = e[: len(u)].tolist(), e[len(u) :].tolist()
        self.next: list[list[tuple[int, int]]] = [[] for _ in self.ids]

    def add(self, x: int) -> None:
        self.next[self.i[x]].append((self.j[x], x))
        self.next[self.j[x]].append((self.i[x], x))

    def tree(self, root: int, most: int | None = None) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
        """Hops and (parent, edge) of what is reachable from a node, breadth first, smaller neighbours first."""
        hops, back, queue = {root: 0}, {}, deque([root])
        while queue:
            a = queue.popleft()
            if most is not None and hops[a] >= most:
                continue
            for b, x in sorted(self.next[a]):
                if b not in hops:
                    hops[b], back[b] = hops[a] + 1, (a, x)
                    queue.append(b)
        return hops, back


class _Rows:
    """Neighbours over places 0..n-1 as arrays: those of a are ``to[start[a]:start[a + 1]]``, over the edges ``by``, in the order of edges."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        m = len(u)
        self.ids, e = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.i, self.j = e[:m], e[m:]
        order = np.lexsort((np.concatenate([np.arange(m), np.arange(m)]), e))
        self.to, self.by = np.concatenate([self.j, self.i])[order], order % max(1, m)
        self.start = np.searchsorted(e[order], np.arange(len(self.ids) + 1))


def greedy_spanner(edges: DataFrame, stretch: float = 3, seed: int = 0, group: str | None = None) -> DataFrame:
    """In hash order, an edge stays if what stays so far joins its ends by no path of at most ``stretch`` times its weight.

    The weight is the column ``w``, or 1, so that a path is then of ``stretch`` hops or fewer.
    """

    def near(g, w, a, b, most):
        """Whether a path of at most ``most`` joins a and b: the nearer of two fronts grows until they can't meet within it."""
        best, heaps, done = ({a: 0.0}, {b: 0.0}), ([(0.0, a)], [(0.0, b)]), (set(), set())
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= most:
            s = 0 if (heaps[0][0][0], len(g.next[heaps[0][0][1]])) <= (heaps[1][0][0], len(g.next[heaps[1][0][1]])) else 1
            d, c = heapq.heappop(heaps[s])
            if c in done[s]:
                continue
            done[s].add(c)
            own, far = best[s], best[1 - s]
            for n, x in g.next[c]:
                e = d + w[x]
                if e + far.get(n, np.inf) <= most:
                    return True
                if e <= most and e < own.get(n, np.inf):
                    own[n] = e
                    heapq.heappush(heaps[s], (e, n))
        return False

    def work(u, v, w):
        g, kept = _Graph(u, v), []
        w = w.tolist()
        for x in _hash_order(u, v, seed).tolist():
            if not near(g, w, g.i[x], g.j[x], stretch * w[x] + 1e-9):
                g.add(x)
                kept.append(x)
        return np.array(kept, int)

    return grouped(edges, work, group, LONG_EDGES)


def congested_growth(edges: DataFrame, ratio: float = 0.4, by: str = "node", seed: int = 0, group: str | None = None) -> DataFrame:
    """From a hashed forest: route the missing edges, find the most crowded ``node`` or ``edge`` (or take the longest path, ``dilation``),
    add the routed edge of largest dilation that crosses it; until the ratio is reached."""

    def work(u, v, w):
        from edgeloom.operators.forest import smallest_forest

        m = len(u)
        order = _hash_order(u, v, seed)
        rank = np.empty(m, int)
        rank[order] = np.arange(m)
        kept = set(smallest_forest(u, v, rank).tolist())
        g, long = AllRoutes(u, v, kept), np.maximum(w, EPS)
        while len(kept) < ratio * m:
            pool = g.rows()
            if not len(pool):
                break
            if by == "node":  # a route's ends count too
                crowd = g.met[:-1] + np.bincount(g.a[pool], minlength=len(g.ids)) + np.bincount(g.b[pool], minlength=len(g.ids))
                top = int(np.argmax(crowd))
                pool = pool[(g.inner[pool] == top).any(1) | (g.a[pool] == top) | (g.b[pool] == top)]
            elif by != "dilation":
                pool = pool[(g.links[pool] == int(np.argmax(g.crowd[:-1]))).any(1)]
            x = int(pool[np.argmax(g.length[pool] / long[pool])])
            kept.add(x)
            g.take(x)
        return np.array(sorted(kept), int)

    return grouped(edges, work, group)


def _scores(u, v, w, kept: set[int], alpha: float, beta_e: float, beta_v: float, p: float, q: float, only: list[int] | None = None) -> tuple[dict[int, float], list[int]]:
    """Support scores of the missing edges by explicit shortest paths, and those without a path."""
    g = Routes(u, v, kept)
    return _rated(g, w, [x for x in (only if only is not None else range(len(u))) if x not in kept], alpha, beta_e, beta_v, p, q)


def _rated(g: Routes, w, want: list[int], alpha: float, beta_e: float, beta_v: float, p: float, q: float) -> tuple[dict[int, float], list[int]]:
    found = {x: g.route(x) for x in want}
    paths, lost = {x: r for x, r in found.items() if r}, [x for x, r in found.items() if r is None]
    ce, cv = np.zeros(len(g.i)), np.zeros(len(g.ids))
    for inner, links in paths.values():
        ce[links] += 1
        cv[inner] += 1

    def norm(c, power):
        if not len(c):
            return 0.0
        return float(c.max()) if np.isinf(power) else float((((c + EPS) ** power).sum() / (len(c) + EPS)) ** (1 / power))

    raw = {x: (len(links) / max(w[x], EPS), norm(ce[links], p), norm(cv[inner], q)) for x, (inner, links) in paths.items()}
    tops = [max((r[k] for r in raw.values()), default=0.0) for k in range(3)]
    powers = (alpha, beta_e, beta_v)
    return {x: float(np.prod([((r[k] + EPS) / (tops[k] + EPS)) ** powers[k] for k in range(3)])) for x, r in raw.items()}, lost


def greedy_support(edges: DataFrame, ratio: float = 0.4, add: int = 1, sample: int | None = None, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 1.0, p: float = 2.0, q: float = 2.0, seed: int = 0, group: str | None = None) -> DataFrame:
    """From a hashed forest, round by round: score the missing edges (or a hashed ``sample`` of them) along shortest paths of what is kept, add
    the ``add`` best; edges without a path come first. ``add=1`` is the exact greedy growth."""

    def work(u, v, w):
        from edgeloom.operators.edges import budget
        from edgeloom.operators.forest import smallest_forest

        m = len(u)
        rank = np.empty(m, int)
        rank[_hash_order(u, v, seed)] = np.arange(m)
        kept = set(smallest_forest(u, v, rank).tolist())
        target = budget(m, ratio)
        turn = 0
        if not sample:
            g, long = AllRoutes(u, v, kept), np.maximum(w, EPS)
            while len(kept) < target:
                rows = g.rows()
                n = g.length[rows]
                raw = n / long[rows], g.norms(rows, g.crowd, g.links, n, p, EPS), g.norms(rows, g.met, g.inner, n - 1, q, EPS)
                s = np.prod([((r + EPS) / (r.max(initial=0.0) + EPS)) ** power for r, power in zip(raw, (alpha, beta_e, beta_v))], axis=0)
                for x in rows[np.lexsort((rows, -np.round(s, 9)))][: min(add, target - len(kept))].tolist() if add > 1 else [int(rows[np.argmax(np.round(s, 9))])]:
                    kept.add(x)
                    g.take(x)
            return np.array(sorted(kept), int)
        g = Routes(u, v, kept)
        while len(kept) < target:
            rest = [x for x in range(m) if x not in kept]
            only = sorted(rest, key=lambda x: hashlib.md5(f"{seed}|{turn}|{x}".encode()).digest())[:sample]
            s, lost = _rated(g, w, only, alpha, beta_e, beta_v, p, q)
            best = lost + sorted(s, key=lambda x: (-round(s[x], 9), x))
            for x in best[: min(add, target - len(kept))]:
                kept.add(x)
                g.add(x)
            turn += 1
        return np.array(sorted(kept), int)

    return grouped(edges, work, group)


class _Swaps:
    """The cost of a support, and of its exchanges: an exchange is made by searching the routes that it can change, and taken back.

    ``links`` and ``inner`` have a row an edge, filled up with places of no edge (m) and no node (n); ``length`` is 0 where there is no route.
    """

    def __init__(self, u, v, kept: set[int], alpha: float, beta_e: float, beta_v: float, p: float = 2.0, q: float = 2.0):
        self.g, self.kept, self.m = Routes(u, v, sorted(kept)), set(kept), len(u)
        self.powers, self.p, self.q = (alpha, beta_e, beta_v), p, q
        self.a, self.b = np.array(self.g.i, int), np.array(self.g.j, int)
        self.length, self.lost = np.zeros(self.m, int), set()
        self.links, self.inner = np.full((self.m, 1), self.m, np.int32), np.full((self.m, 1), len(self.g.ids), np.int32)
        for x in range(self.m):
            if x not in kept:
                self._put(x, self.g.route(x))

    def _get(self, x: int):
        k = self.length[x]
        return (self.inner[x, : k - 1].tolist(), self.links[x, :k].tolist()) if k else None if x in self.lost else ()

    def _put(self, x: int, route) -> None:
        """The route of a missing edge; None where there is none, () for an edge that is kept."""
        old = self.length[x]
        self.links[x, :old], self.inner[x, :old] = self.m, len(self.g.ids)
        self.lost.discard(x)
        if not route:
            self.length[x] = 0
            if route is None:
                self.lost.add(x)
            return
        inner, links = route
        self.length[x] = k = len(links)
        if k > self.links.shape[1]:
            wide = lambda a, fill: np.concatenate([a, np.full((self.m, 2 * k - a.shape[1]), fill, np.int32)], axis=1)
            self.links, self.inner = wide(self.links, self.m), wide(self.inner, len(self.g.ids))
        self.links[x, :k], self.inner[x, : k - 1] = links, inner

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """The missing edges that have a route, and their scores, as ``_rated`` has them."""
        rows = np.flatnonzero(self.length)
        n = self.length[rows]
        width, out = int(n.max(initial=1)), np.ones(len(rows))
        for power, raw in zip(self.powers, (lambda: n, lambda: self._norm(self.links[rows, :width], n, self.m, self.p), lambda: self._norm(self.inner[rows, :width], n - 1, len(self.g.ids), self.q))):
            if power:
                r = raw()
                out *= ((r + EPS) / (r.max(initial=0.0) + EPS)) ** power
        return rows, out

    def _norm(self, at: np.ndarray, size: np.ndarray, none: int, power: float) -> np.ndarray:
        c = np.bincount(at.ravel(), minlength=none + 1) + (0.0 if np.isinf(power) else EPS)
        c[none] = 0.0
        if np.isinf(power):
            return c[at].max(1, initial=0.0)
        c = c**power
        return np.where(size > 0, (c[at].sum(1) / (size + EPS)) ** (1 / power), 0.0)

    def cost(self) -> float:
        s = self.scores()[1]
        return float(s.sum()) / max(1, len(s)) + len(self.lost)

    def order(self) -> tuple[list[int], list[int]]:
        """The missing edges, worst supported first, and the kept ones, least used first."""
        rows, s = self.scores()
        times = np.bincount(self.links[rows].ravel(), minlength=self.m + 1)
        return sorted(self.lost) + rows[np.lexsort((rows, -np.round(s, 9)))].tolist(), sorted(self.kept, key=lambda y: (times[y], y))

    def users(self) -> tuple[np.ndarray, np.ndarray]:
        """(first places, edges): the routes that have kept edge y are those of the edges from first[y] to first[y + 1]."""
        rows = np.flatnonzero(self.length)
        flat = self.links[rows].ravel()
        order = np.argsort(flat, kind="stable")
        return np.searchsorted(flat[order], np.arange(self.m + 1)), rows[order // self.links.shape[1]]

    def without(self) -> list[dict]:
        """For each kept edge the routes that it and its users have without it."""
        first, who = self.users()
        out: list[dict] = [{} for _ in range(self.m)]
        for y in self.kept:
            self.g.drop(y)
            out[y] = {z: self.g.route(z) for z in (y, *who[first[y] : first[y + 1]].tolist())}
            self.g.add(y)
        return out

    def exchanged(self, x: int, least: list[int], without: list[dict], now: float) -> float | None:
        """The cost after the first exchange of x for one of ``least`` that lowers it, which is made; None if none does."""
        g, around = self.g, set(self.links[x, : self.length[x]].tolist())
        far, near = g.hops(g.i[x]), g.hops(g.j[x])
        best = np.minimum(far[self.a] + near[self.b], near[self.a] + far[self.b]) + 1  # the shortest path over x of each edge's ends
        rows = np.array([*np.flatnonzero(self.length).tolist(), *sorted(self.lost)], int)
        hit = rows[best[rows] <= np.where(self.length[rows] > 0, self.length[rows], FAR - 1)]
        best = best.tolist()
        old = {x: self._get(x)}
        self._put(x, ())
        g.add(x)
        for z in hit.tolist():
            if z != x:
                old[z] = self._get(z)
                self._put(z, g.route(z))
        if len(self.lost) + 1 >= now:  # an edge that alone joins its ends, and that x doesn't go around, costs one more
            least = [y for y in least if without[y][y] or y in around]
        first, who = self.users()
        for y in least:
            g.drop(y)
            held = {y: ()}
            for z in (y, *who[first[y] : first[y + 1]].tolist()):
                if z != y:
                    held[z] = self._get(z)
                known = without[y].get(z)
                self._put(z, known if known and best[z] > len(known[1]) else g.route(z))
            if len(self.lost) < now and (new := self.cost()) < now - 1e-12:
                self.kept = self.kept - {y} | {x}
                return new
            g.add(y)
            for z, route in held.items():
                self._put(z, route)
        g.drop(x)
        for z, route in old.items():
            self._put(z, route)
        return None


def swapped(edges: DataFrame, support: DataFrame, passes: int | None = None, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 0.0, group: str | None = None, width: tuple[int, int] | None = None) -> DataFrame:
    """Exchange a kept edge for a missing one, the worst-supported missing edges and the least used kept edges first, until no exchange lowers the mean score product.

    An exchange that would cut the support apart costs more than any other. ``passes`` bounds the exchanges of a group, and ``width`` how many missing
    and kept edges are tried for each, from the worst on again after each exchange; by default there is no bound, rounds go through all missing edges,
    and the result is a local optimum over all pairs.
    """
    e = edges.join(support.select("u", "v", F.lit(1.0).alias("__in")), ["u", "v"], "left").withColumn("w", F.coalesce("__in", F.lit(0.0)))

    def work(u, v, w):
        s = _Swaps(u, v, set(np.flatnonzero(w > 0).tolist()), alpha, beta_e, beta_v)
        now, turn, better = s.cost(), 0, True
        while better and (passes is None or turn < passes):
            better = False
            worst, least = s.order()
            if width:
                worst, least = worst[: width[0]], least[: width[1]]
            without = s.without()
            for x in worst:
                if (new := s.exchanged(x, least, without, now)) is not None:
                    now, better = new, True
                    if width or passes:
                        break
                    least, without = s.order()[1], s.without()
            turn += 1
        return np.array(sorted(s.kept), int)

    return grouped(e, work, group)


def low_stretch_tree(edges: DataFrame, roots: int = 8, group: str | None = None) -> DataFrame:
    """Of breadth-first trees from several roots, for each component the one with the least mean stretch.

    Roots: the two of largest degree, both ends of a double sweep, and places along the path between them.
    """

    def work(u, v, w):
        g = _Graph(u, v)
        for x in range(len(u)):
            g.add(x)
        nodes, low = smallest_labels(np.array(g.i), np.array(g.j))
        order, edge_order = np.lexsort((nodes, low)), np.argsort(low[np.searchsorted(nodes, g.i)], kind="stable")
        parts = np.split(nodes[order], np.flatnonzero(np.diff(low[order])) + 1)
        own_edges = np.split(edge_order, np.flatnonzero(np.diff(low[np.searchsorted(nodes, np.array(g.i)[edge_order])])) + 1)

        def far(hops):
            most = max(hops.values())
            return min(n for n, h in hops.items() if h == most)

        out = []
        for own, mine in zip(parts, own_edges, strict=True):
            own, mine = own.tolist(), mine.tolist()
            first = sorted(own, key=lambda a: (-len(g.next[a]), a))[:2]
            s = far(g.tree(first[0])[0])
            hops, back = g.tree(s)
            t = far(hops)
            path = [t]
            while path[-1] != s:
                path.append(back[path[-1]][0])
            tries = list(dict.fromkeys([*first, s, t, *[path[len(path) * k // 4] for k in (1, 2, 3)]]))[:roots]
            best = None
            for r in tries:
                hops, back = g.tree(r)
                up = {n: p for n, (p, _) in back.items()}
                total = 0
                for x in mine:
                    a, b, d = g.i[x], g.j[x], 0
                    while a != b:
                        if hops[a] < hops[b]:
                            a, b = b, a
                        a, d = up[a], d + 1
                    total += d
                if best is None or total < best[0]:
                    best = total, [x for _, x in back.values()]
            out += best[1]
        return np.array(sorted(out), int)

    return grouped(edges, work, group, LONG_EDGES)


def uniform_tree(edges: DataFrame, seed: int = 0, group: str | None = None) -> DataFrame:
    """A spanning forest drawn uniformly: loop-erased hashed walks to the growing tree."""

    def work(u, v, w):
        g = _Rows(u, v)
        rng = np.random.default_rng(seed)
        nodes, low = smallest_labels(g.i, g.j)
        inside = set(np.unique(low).tolist())
        kept = []
        for a in nodes.tolist():
            step: dict[int, tuple[int, int]] = {}
            at = a
            while at not in inside:
                first = int(g.start[at])
                k = first + int(rng.integers(int(g.start[at + 1]) - first))
                step[at] = int(g.to[k]), int(g.by[k])
                at = step[at][0]
            at = a
            while at not in inside:
                inside.add(at)
                at, x = step[at]
                kept.append(x)
        return np.array(sorted(kept), int)

    return grouped(edges, work, group, LONG_EDGES)


def forest_fire(edges: DataFrame, ratio: float, burn: float | None = None, fires: int | None = None, seed: int = 0, group: str | None = None) -> DataFrame:
    """The share of edges that burn most often: fires start at hashed nodes and spread to a geometric number of unburnt neighbours.

    There are as many fires as it takes to burn 5 times the number of edges, as published; ``fires`` ends them sooner. Where nothing can burn
    (``burn`` is 0, or all edges are loops) there is none, and the first edges are taken.
    """
    burn = 0.2 + 0.4 * ratio if burn is None else burn

    def work(u, v, w):
        from edgeloom.operators.edges import budget

        g = _Rows(u, v)
        rng = np.random.default_rng(seed)
        times, burnt, fire, seen = np.zeros(len(u), int), 0, -1, np.full(len(g.ids), -1)
        start, to, by, hits, mark = (memoryview(np.ascontiguousarray(x)) for x in (g.start, g.to, g.by, times, seen))  # single places are read faster
        goal = 5 * len(u) if burn > 0 and (g.i != g.j).any() else 0
        while burnt < goal and (fires is None or fire + 1 < fires):
            fire += 1
            a = int(rng.integers(len(g.ids)))
            mark[a], queue, size = fire, deque([a]), 1
            while queue:
                a = queue.popleft()
                k = int(rng.geometric(1 - burn)) - 1
                if not k:
                    continue
                first, deg = start[a], start[a + 1] - start[a]
                if 2 * (size + k) <= deg:  # most neighbours are unburnt: draw until k of these are found
                    caught = []
                    while len(caught) < k:
                        x = first + int(rng.integers(deg))
                        if mark[to[x]] != fire:
                            mark[to[x]] = fire
                            caught.append(x)
                else:
                    near = np.flatnonzero(seen[g.to[first : first + deg]] != fire) + first
                    caught = near[rng.permutation(len(near))[:k]].tolist()
                    seen[g.to[caught]] = fire
                for x in caught:
                    hits[by[x]] += 1
                    queue.append(to[x])
                burnt += len(caught)
                size += len(caught)
        return np.lexsort((np.arange(len(u)), -times))[: budget(len(u), ratio, "round")]

    return grouped(edges, work, group, LONG_EDGES)


def rank_degree(edges: DataFrame, ratio: float, rho: float = 0.1, seeds: int = 10, seed: int = 0, group: str | None = None) -> DataFrame:
    """From hashed seeds, each node of the frontier keeps its ``rho`` share of neighbours by degree, whose ends are the next frontier."""

    def work(u, v, w):
        from edgeloom.operators.edges import budget

        g = _Rows(u, v)
        n, deg = len(g.ids), np.diff(g.start)
        order = np.lexsort((g.to, -deg[g.to], np.repeat(np.arange(n), deg)))  # each node's neighbours by degree
        to, by = g.to[order], g.by[order]
        rng = np.random.default_rng(seed)
        target, kept, many, seen, share = budget(len(u), ratio, "round"), np.zeros(len(u), bool), 0, np.zeros(n, bool), rho
        line, place = rng.permutation(n), 0  # new seeds are the next unseen nodes of a hashed order, which is drawn anew for each share
        front = line[:seeds].tolist()
        while many < target and share < 1:
            nxt = []
            for a in front:
                if seen[a]:
                    continue
                seen[a] = True
                s = g.start[a]
                for k in range(s, s + max(1, int(deg[a] * share))):
                    if not kept[by[k]] and many < target:
                        kept[by[k]] = True
                        many += 1
                        nxt.append(int(to[k]))
            front = nxt
            if all(seen[a] for a in front):
                front = []
                while len(front) < seeds and place < n:
                    if not seen[line[place]]:
                        front.append(int(line[place]))
                    place += 1
                if not front:
                    seen[:] = False
                    share += 0.1
                    line, place = rng.permutation(n), seeds
                    front = line[:seeds].tolist()
        if many < target:
            fill = np.flatnonzero(~kept)
            kept[fill[np.lexsort((fill, -deg[g.i[fill]] - deg[g.j[fill]]))[: target - many]]] = True
        return kept

    return grouped(edges, work, group, LONG_EDGES)


def resistance(edges: DataFrame, group: str | None = None, most_nodes: int = 5000) -> DataFrame:
    """``(u, v, resistance)`` of weighted edges, exactly, from the pseudo-inverse of the Laplacian of each group.

    A whole graph (no ``group``) above ``most_nodes`` is solved column by column in ``resistance_by_columns``; a group above it is refused.
    """
    if group is None and edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().count() > most_nodes:
        return resistance_by_columns(edges)
    g = edges.withColumn("__g", F.col(group) if group else F.lit(0)).withColumn("__w", F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0))

    def run(t: pa.Table) -> pa.Table:
        u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "__w"))
        ids, e = np.unique(np.concatenate([u, v]), return_inverse=True)
        n = len(ids)
        if n > most_nodes:
            raise ValueError(f"{n} nodes; use sketched_resistance beyond {most_nodes}")
        i, j = e[: len(u)], e[len(u) :]
        lap = np.zeros((n, n))
        np.add.at(lap, (i, j), -w)
        np.add.at(lap, (j, i), -w)
        lap[np.arange(n), np.arange(n)] = -lap.sum(1)
        inv = np.linalg.pinv(lap, hermitian=True)
        return pa.table([u, v, inv[i, i] + inv[j, j] - 2 * inv[i, j]], ["u", "v", "resistance"])

    return g.select("u", "v", "__w", "__g").groupBy("__g").applyInArrow(run, "u long, v long, resistance double")


def resistance_by_columns(edges: DataFrame, tasks: int = 64) -> DataFrame:
    """``(u, v, resistance)`` of weighted edges to about 12 digits, from columns of the Laplacian's inverse by conjugate gradients.

    Each of ``tasks`` tasks holds the sparse graph and solves for its share of the nodes; every edge gets a part from the column of either
    end. Memory of a task grows with edges, and the work with nodes times edges, as every column of the inverse is needed.
    """
    e = stored(edges.select("u", "v", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w")), "resistance-edges")

    def run(t: pa.Table) -> pa.Table:
        u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "w"))
        g = _Rows(u, v)
        n, w = len(g.ids), w[g.by]
        first = g.start[:-1]
        deg = np.add.reduceat(w, first)
        low = smallest_labels(g.i, g.j)[1]
        size = np.bincount(low)
        out = []
        for node in range(t.column("task")[0].as_py(), n, tasks):
            r = np.where(low == low[node], -1.0 / size[low[node]], 0.0)
            r[node] += 1.0
            x, z = np.zeros(n), r / deg
            p, rz = z.copy(), float(r @ z)
            least = 1e-28 * rz
            for _ in range(10 * n + 100):
                if rz <= least:
                    break
                ap = deg * p - np.add.reduceat(w * p[g.to], first)
                a = rz / float(p @ ap)
                x += a * p
                r -= a * ap
                z = r / deg
                new = float(r @ z)
                p = z + new / rz * p
                rz = new
            else:
                raise RuntimeError("no convergence of a resistance")
            other = g.to[g.start[node] : g.start[node + 1]]
            out.append((np.full(len(other), g.ids[node]), g.ids[other], x[node] - x[other]))
        if not out:
            return pa.table([g.ids[:0], g.ids[:0], np.empty(0)], ["u", "v", "part"])
        a, b, c = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.table([np.minimum(a, b), np.maximum(a, b), c], ["u", "v", "part"])

    every = e.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return every.groupBy("task").applyInArrow(run, "u long, v long, part double").groupBy("u", "v").agg(F.sum("part").alias("resistance"))


def sketched_resistance(edges: DataFrame, projections: int | None = None, seed: int = 0, group: str | None = None) -> DataFrame:
    """``(u, v, resistance)`` estimated: hashed signs of edges projected, and Laplacian systems solved by conjugate gradients."""
    g = edges.withColumn("__g", F.col(group) if group else F.lit(0)).withColumn("__w", F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0))

    def run(t: pa.Table) -> pa.Table:
        if len(t) > MOST_EDGES:
            raise ValueError(f"a group of {len(t)} edges; cut it into clusters of {MOST_EDGES} at most")
        t = t.sort_by([("u", "ascending"), ("v", "ascending")])
        u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "__w"))
        ids, e = np.unique(np.concatenate([u, v]), return_inverse=True)
        n, i, j = len(ids), e[: len(u)], e[len(u) :]
        k = projections or int(np.ceil(4 * np.log(max(2, n))))
        rng = np.random.default_rng(seed)
        b = np.zeros((n, k))
        sign = rng.choice([-1.0, 1.0], (len(u), k)) * np.sqrt(w)[:, None] / np.sqrt(k)
        np.add.at(b, i, sign)
        np.add.at(b, j, -sign)

        def apply(x):
            d = w[:, None] * (x[i] - x[j])
            out = np.zeros_like(x)
            np.add.at(out, i, d)
            np.add.at(out, j, -d)
            return out

        diag = np.bincount(i, w, n) + np.bincount(j, w, n)
        x, r = np.zeros_like(b), b.copy()
        z = r / diag[:, None]
        p, rz = z.copy(), (r * z).sum(0)
        for _ in range(4 * n):
            ap = apply(p)
            a = rz / np.maximum((p * ap).sum(0), 1e-300)
            x += a * p
            r -= a * ap
            if np.abs(r).max() < 1e-9:
                break
            z = r / diag[:, None]
            new = (r * z).sum(0)
            p = z + new / np.maximum(rz, 1e-300) * p
            rz = new
        return pa.table([u, v, ((x[i] - x[j]) ** 2).sum(1)], ["u", "v", "resistance"])

    return g.select("u", "v", "__w", "__g").groupBy("__g").applyInArrow(run, "u long, v long, resistance double")
