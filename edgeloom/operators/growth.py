"""Trees of low stretch and lazy growth, for graphs (or clusters) of bounded size; random shortest-path forests of any size.

The bounded ones run in one Arrow task per group, like the other sequential selectors.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scoring import EPS
from edgeloom.operators.components import components
from edgeloom.operators.edges import adjacency, budget, key
from edgeloom.operators.paths import nearest_source, weighted_distances
from edgeloom.operators.routes import Routes
from edgeloom.operators.sequential import LONG_EDGES, _hash_order, grouped
from edgeloom.session import stored


def random_shortest_forest(edges: DataFrame, seed: int = 0, weight: str | None = None) -> DataFrame:
    """``(u, v)``: for each component a hashed root, and for each other node a hashed edge to a neighbour that is on a shortest path to it.

    With ``weight`` paths are shortest by that column, else by hops. Rounds of joins, one per hop of the
    deepest tree; no group is gathered.
    """
    e = stored(edges.select("u", "v", *([F.col(weight).cast("double").alias("w")] if weight else [])), "rspt-edges")
    label = components(e)
    root = label.withColumn("k", key("node", seed=seed)).groupBy("component").agg(F.min_by("node", F.struct("k", "node")).alias("node"))
    if weight:
        far = weighted_distances(e, root.select("node")).select("node", "dist")
    else:
        far = nearest_source(e, root.select("node")).select("node", "dist")
    far = stored(far, "rspt-far")
    a = adjacency(e).join(far.toDF("src", "ds"), "src").join(far.toDF("dst", "dt"), "dst")
    step = F.col("w") if weight else F.lit(1)
    a = a.where(F.abs(F.col("ds") + step - F.col("dt")) < 1e-9).withColumn("k", key("src", "dst", seed=seed))
    up = a.groupBy("dst").agg(F.min_by("src", F.struct("k", "src")).alias("src"))
    return up.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))


class _Forest:
    """A growing forest over places 0..n-1: for each node its root, parent, the weight of the edge to it, and its distance and hops from the root."""

    def __init__(self, n: int):
        self.root, self.parent = list(range(n)), [-1] * n
        self.up, self.far, self.depth = [0.0] * n, [0.0] * n, [0] * n
        self.own: list[list[int]] = [[a] for a in range(n)]
        self.next: list[list[tuple[int, float]]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, w: float) -> tuple[int, int]:
        """The roots (stays, gone): the smaller tree hangs below the larger one."""
        if len(self.own[self.root[a]]) < len(self.own[self.root[b]]):
            a, b = b, a
        stays, gone = self.root[a], self.root[b]
        self.own[stays] += self.own[gone]
        self.own[gone] = []
        self.next[a].append((b, w))
        self.next[b].append((a, w))
        todo = [(b, a, w)]
        while todo:
            x, p, length = todo.pop()
            self.root[x], self.parent[x], self.up[x] = stays, p, length
            self.far[x], self.depth[x] = self.far[p] + length, self.depth[p] + 1
            todo += [(y, x, z) for y, z in self.next[x] if y != p]
        return stays, gone

    def sums(self, ends: list[int], share: list[float], top: int) -> dict[int, float]:
        """For each end the sum over all ends of their share times the distance to it; ``top`` is a node above all of them."""
        below: dict[int, float] = {}
        for t, c in zip(ends, share):
            below[t] = below.get(t, 0.0) + c
        if len(below) == 1:
            return {ends[0]: 0.0}
        parent, far, depth, up, whole = self.parent, self.far, self.depth, self.up, sum(below.values())
        start = sum(c * (far[t] - far[top]) for t, c in below.items())
        for t in list(below):
            while t != top and parent[t] not in below:
                t = parent[t]
                below[t] = 0.0
        order = sorted(below, key=depth.__getitem__)
        for t in reversed(order[1:]):
            below[parent[t]] += below[t]
        out = {top: start}
        for t in order[1:]:
            out[t] = out[parent[t]] + up[t] * (whole - 2 * below[t])
        return out


def _ends(u: np.ndarray, v: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    ids, e = np.unique(np.concatenate([u, v]), return_inverse=True)
    return len(ids), e[: len(u)], e[len(u) :]


def _greedy_tree(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, alpha: float, eta: float) -> list[int]:
    """Places of the edges that are joined, one by one, by the score of their cut and of the stretch that they give to it.

    Only cuts that grow by a join are judged anew, by sums over the paths to their ends, so there is no matrix of distances.
    """
    tree, cuts = _Forest(n), []
    near: list[dict[int, int]] = [{} for _ in range(n)]  # for each tree the cuts to others
    i, j, w = i.tolist(), j.tolist(), w.tolist()
    for x in range(len(i)):
        k = near[i[x]].get(j[x])
        if k is None:
            near[i[x]][j[x]] = near[j[x]][i[x]] = len(cuts)
            cuts.append([x])
        else:
            cuts[k].append(x)
    size, least, first, most = np.zeros(len(cuts)), np.zeros(len(cuts)), np.zeros(len(cuts), int), np.zeros(len(cuts))
    live = np.ones(len(cuts), bool)

    def judge(k):
        cut = cuts[k]
        one = tree.root[i[cut[0]]]
        a = [i[x] if tree.root[i[x]] == one else j[x] for x in cut]
        b = [j[x] if y == i[x] else i[x] for x, y in zip(cut, a)]
        share = [1.0 / max(w[x], EPS) for x in cut]
        left, right, whole = tree.sums(a, share, one), tree.sums(b, share, tree.root[b[0]]), sum(share)
        total = np.array([left[y] + right[z] + w[x] * whole for x, y, z in zip(cut, a, b)]) / (len(cut) + EPS)
        at = int(np.argmin(np.round(total, 12)))  # of one cut the edge with the least stretch scores best, the first of equals
        size[k], least[k], first[k], most[k] = len(cut), total[at], cut[at], total.max()

    score = lambda k: np.where(live[k], np.round(((size[k] + EPS) / (tops[0] + EPS)) ** eta / np.maximum(((least[k] + EPS) / (tops[1] + EPS)) ** alpha, EPS), 12), -1.0)
    for k in range(len(cuts)):
        judge(k)
    taken, tops, scores, changed = [], None, None, []
    for _ in range(n - 1):
        now = float(size.max(initial=0.0)), float(most.max(initial=0.0))  # of cuts that are gone both are 0
        if not now[0]:
            break
        if now != tops:
            tops = now
            scores = score(slice(None))
        elif changed:
            scores[changed] = score(np.array(changed))
        best = np.flatnonzero(scores == scores.max())
        x = int(first[best].min())
        taken.append(x)
        stays, gone = tree.join(i[x], j[x], w[x])
        changed = []
        for other, k in near[gone].items():
            both = near[stays].get(other) if other != stays else k
            del near[other][gone]
            if both is None:
                near[stays][other] = near[other][stays] = k
                continue
            if other != stays:
                cuts[both] = sorted(cuts[both] + cuts[k])
                judge(both)
                changed.append(both)
            cuts[k] = []
            live[k], size[k], most[k] = False, 0.0, 0.0
            changed.append(k)
        near[gone] = {}
        if 2 * (dead := len(live) - np.count_nonzero(live)) > len(live) and dead > 1000:
            keep = np.flatnonzero(live)
            place = dict(zip(keep.tolist(), range(len(keep))))
            cuts = [cuts[k] for k in place]
            size, least, first, most, live = size[keep], least[keep], first[keep], most[keep], live[keep]
            near = [{o: place[k] for o, k in t.items()} for t in near]
            tops, changed = None, []
    return taken


def greedy_low_stretch(edges: DataFrame, alpha: float = 1.0, eta: float = 1.0, group: str | None = None) -> DataFrame:
    """A spanning forest that joins, again and again, the two trees and the edge between them with the best score.

    The score of an edge is the size of its cut (relative to the largest, to the power ``eta``) over the mean stretch that
    the edges of the cut would get by it (relative to the largest, to the power ``alpha``).
    """

    def work(u, v, w):
        n, i, j = _ends(u, v)
        return np.array(sorted(_greedy_tree(i, j, w, n, alpha, eta)), int)

    return grouped(edges, work, group, LONG_EDGES)


def local_low_stretch(edges: DataFrame, passes: int = 10, alpha: float = 1.0, eta: float = 1.0, group: str | None = None) -> DataFrame:
    """The greedy tree, then up to ``passes`` times the exchange of an edge on a cycle for the edge that closes it that lowers the total stretch most."""

    def work(u, v, w):
        n, i, j = _ends(u, v)
        kept = set(_greedy_tree(i, j, w, n, alpha, eta))
        length = np.maximum(w, EPS)
        for _ in range(passes):
            tree = _Forest(n)
            for x in sorted(kept):
                tree.join(int(i[x]), int(j[x]), float(w[x]))
            best = _exchange(tree, i, j, w, length, sorted(kept))
            if best is None:
                break
            kept = kept - {best[1]} | {best[0]}
        return np.array(sorted(kept), int)

    return grouped(edges, work, group, LONG_EDGES)


def _exchange(tree: _Forest, i: np.ndarray, j: np.ndarray, w: np.ndarray, length: np.ndarray, kept: list[int]) -> tuple[int, int] | None:
    """(edge that comes, edge of the tree that goes) which lower the total stretch most; None if no exchange lowers it."""
    n, m = len(tree.root), len(i)
    parent, up, far, depth = (np.array(x) for x in (tree.parent, tree.up, tree.far, tree.depth))
    tin, end = np.zeros(n, int), np.zeros(n, int)  # the nodes below a node stand at tin..end of the order
    clock = 0
    for r in np.flatnonzero(parent < 0).tolist():
        todo = [r]
        while todo:
            x = todo.pop()
            if x < 0:
                end[~x] = clock
                continue
            tin[x] = clock
            clock += 1
            todo.append(~x)
            todo += [y for y, _ in tree.next[x] if y != tree.parent[x]]
    a, b = i.copy(), j.copy()
    while (apart := np.flatnonzero(a != b)).size:  # up to the node where both ends meet
        p, q = a[apart], b[apart]
        high, low = depth[p] >= depth[q], depth[q] >= depth[p]
        a[apart], b[apart] = np.where(high, parent[p], p), np.where(low, parent[q], q)
    dist = far[i] + far[j] - 2 * far[a]
    now = float((dist / length).sum())
    ti, tj = tin[i], tin[j]
    order = np.argsort(np.concatenate([ti, tj]), kind="stable")
    edge_of, at = order % max(1, m), np.concatenate([ti, tj])[order]
    inner = np.argsort(tin)  # nodes in the order
    enter, leave, upward = tin[inner], end[inner], up[inner]

    def sums(nodes, share, top):
        """``_Forest.sums`` for many ends, by sums along the order of nodes."""
        c = np.bincount(tin[nodes], share, n)
        held = np.concatenate([[0.0], np.cumsum(c)])
        lift = upward * (held[leave] - held[enter])
        if top >= 0:
            lift[: tin[top] + 1] = 0.0
            lift[end[top] :] = 0.0
        step = np.zeros(n + 1)
        step[:n] += lift
        np.subtract.at(step, leave, lift)
        path = np.cumsum(step)[tin[nodes]]
        below = far[nodes] - (far[top] if top >= 0 else 0.0)
        return float((share * below).sum()) + share.sum() * below - 2 * path

    best = (now - 1e-9, -1, -1)
    for y in kept:  # without y its tree falls into what is below it and the rest
        c = int(i[y]) if tree.parent[i[y]] == j[y] else int(j[y])
        first, last = np.searchsorted(at, (tin[c], end[c]))
        own = np.sort(edge_of[first:last])
        once = np.ones(len(own), bool)
        once[1:] &= own[1:] != own[:-1]
        once[:-1] &= own[1:] != own[:-1]
        cross = own[once]
        inside = (ti[cross] >= tin[c]) & (ti[cross] < end[c])
        p, q, share = np.where(inside, i[cross], j[cross]), np.where(inside, j[cross], i[cross]), 1.0 / length[cross]
        if 50 * len(cross) > n:
            near, off = sums(p, share, c), sums(q, share, -1)
        else:
            s = share.tolist()
            root = tree.root[c]
            near, off = (np.array([d[x] for x in e]) for e, d in ((e, tree.sums(e, s, t)) for e, t in ((p.tolist(), c), (q.tolist(), root))))
        total = now - float((dist[cross] / length[cross]).sum()) + near + off + w[cross] * share.sum()
        k = int(np.argmin(np.round(total, 9)))
        if total[k] < best[0] - 1e-9:
            best = (float(total[k]), int(cross[k]), y)
    return None if best[1] < 0 else best[1:]


def lazy_growth(edges: DataFrame, ratio: float = 0.4, score: str = "log", alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 1.0, radius: int = 1, add: int | None = None, seed: int = 0, group: str | None = None) -> DataFrame:
    """From a hashed forest, missing edges are added best first from a heap whose entries may be old.

    Every missing edge is routed along a shortest path of what is kept. ``log`` scores it by dilation times one plus the logarithms of the
    largest congestions on its path, ``joint`` by the product of dilation and mean-square congestions. An edge that is added makes
    the entries stale whose path comes within ``radius`` hops of its ends; a stale entry that reaches the top is
    routed and scored anew and goes back. Each group adds at most ``add`` edges.
    """

    def work(u, v, w):
        from edgeloom.operators.forest import smallest_forest

        m = len(u)
        rank = np.empty(m, int)
        rank[_hash_order(u, v, seed)] = np.arange(m)
        kept = set(smallest_forest(u, v, rank).tolist())
        g = Routes(u, v, kept)
        e_con, v_con = np.zeros(m), np.zeros(len(g.ids))
        route: dict[int, tuple[list[int], list[int]]] = {}

        def routed(x: int, found: tuple[list[int], list[int]] | None = None) -> None:
            if x in route:
                e_con[route[x][1]] -= 1
                v_con[route[x][0]] -= 1
            route[x] = inner, links = found or g.route(x)
            e_con[links] += 1
            v_con[inner] += 1

        def rated(x: int) -> float:
            inner, links = route[x]
            dil = len(links) / max(w[x], EPS)
            tops = (e_con[links].max(initial=0.0), v_con[inner].max(initial=0.0))
            if score == "log":
                return dil * (1 + beta_e * np.log1p(tops[0]) + beta_v * np.log1p(tops[1]))
            mean = lambda c: np.sqrt(((c + EPS) ** 2).sum() / (len(c) + EPS)) if len(c) else 0.0
            return (dil + EPS) ** alpha * (mean(e_con[links]) + EPS) ** beta_e * (mean(v_con[inner]) + EPS) ** beta_v

        missing = [x for x in range(m) if x not in kept]
        for x, found in g.forest_routes(missing).items():
            routed(x, found)
        made, stamp = dict.fromkeys(missing, 0), np.zeros(len(g.ids), int)
        heap = [(-round(rated(x), 9), x) for x in missing]
        heapq.heapify(heap)
        left = max(0, budget(m, ratio) - len(kept))
        left, turn = min(left, len(missing), m if add is None else add), 0
        while left and heap:
            _, x = heapq.heappop(heap)
            if stamp[[g.i[x], g.j[x], *route[x][0]]].max() > made[x]:
                routed(x)
                made[x] = turn
                heapq.heappush(heap, (-round(rated(x), 9), x))
                continue
            turn, left = turn + 1, left - 1
            e_con[route[x][1]] -= 1
            v_con[route[x][0]] -= 1
            del route[x]
            kept.add(x)
            g.add(x)
            for end in (g.i[x], g.j[x]):
                for b in g.around(end, radius):
                    stamp[b] = turn
        return np.array(sorted(kept), int)

    return grouped(edges, work, group)


def grown_path_trace(edges: DataFrame, ratios: list[float], grow, **options) -> DataFrame:
    """``(step, u, v)``: supports that ``grow(edges, ratio=...)`` gives at growing ratios, one step each."""
    out = None
    for i, r in enumerate(ratios):
        s = grow(edges, ratio=r, **options).select(F.lit(i).alias("step"), "u", "v")
        out = s if out is None else out.unionByName(s)
    return out


def first_step(trace: DataFrame) -> DataFrame:
    """``(u, v, step)``: when each edge of a trace came in."""
    w = Window.partitionBy("u", "v")
    return trace.withColumn("first", F.min("step").over(w)).where("step = first").select("u", "v", "step")
