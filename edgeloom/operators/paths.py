"""Breadth-first distances and rooted forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import adjacency
from edgeloom.session import dropped, stored


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """``(source, node, dist)`` in hops, up to ``most``; one frontier a round, for all sources at once."""
    adj = adjacency(stored(edges.select("u", "v"), "bfs-edges"))  # every round reads it
    at = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist")).distinct(), "bfs")
    seen = at
    d = 0
    while most is None or d < most:
        d += 1
        nxt = at.join(adj.withColumnRenamed("src", "node"), "node").select("source", F.col("dst").alias("node")).distinct()
        nxt = stored(nxt.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(d)), "bfs")
        if not nxt.limit(1).count():
            break
        seen, at = seen.unionByName(nxt.select("source", "node", "dist")), nxt
        if d % 8 == 0:
            seen = stored(seen, "bfs-seen")
    return seen


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node, source, dist)``: the nearest source of every node it reaches, the smallest of equals; sources once a node."""
    adj = adjacency(stored(edges.select("u", "v"), "vor-edges")).withColumnRenamed("src", "node")
    at = seen = stored(sources.select("node", F.col("node").alias("source"), F.lit(0).alias("dist")).distinct(), "vor")
    d = 0
    while True:
        d += 1
        nxt = at.join(adj, "node").groupBy(F.col("dst").alias("node")).agg(F.min("source").alias("source"))
        nxt = stored(nxt.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d)), "vor")
        if not nxt.limit(1).count():
            return seen
        seen, at = seen.unionByName(nxt), nxt
        if d % 8 == 0:
            seen = stored(seen, "vor-seen")


def weighted_distances(edges: DataFrame, sources: DataFrame, weight: str = "w") -> DataFrame:
    """``(source, node, dist)`` by rounds of relaxation until nothing gets shorter."""
    adj = adjacency(stored(edges.select("u", "v", F.col(weight).alias("w")), "bf-edges")).withColumnRenamed("src", "node")
    best = stored(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")).distinct(), "bf")
    changed = best
    while True:
        near = changed.join(adj, "node").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        both = best.join(near, ["source", "node"], "full").select("source", "node", F.least(F.coalesce("dist", F.lit(float("inf"))), F.coalesce("new", F.lit(float("inf")))).alias("d"), (F.coalesce("new", F.lit(float("inf"))) < F.coalesce("dist", F.lit(float("inf")))).alias("moved"))
        both = stored(both.withColumnRenamed("d", "dist"), "bf")
        changed = both.where("moved").select("source", "node", "dist")
        if not changed.limit(1).count():
            return both.select("source", "node", "dist")
        best = both.select("source", "node", "dist")


def paths_to(edges: DataFrame, root: DataFrame) -> DataFrame:
    """``(target, step, node)``: for every node that a root reaches, a shortest path back to it, over the smallest parent at each step."""
    e = stored(edges.select("u", "v"), "path-edges")
    far = stored(nearest_source(e, root).select("node", "dist"), "path-far")
    a = adjacency(e).join(far.toDF("src", "ds"), "src").join(far.toDF("dst", "dt"), "dst").where("dt = ds + 1")
    up = stored(a.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent")), "path-up")
    at = out = far.select(F.col("node").alias("target"), F.lit(0).cast("long").alias("step"), "node")
    for s in range(1, int(far.agg(F.coalesce(F.max("dist"), F.lit(0))).first()[0]) + 1):
        at = stored(at.join(up, "node").select("target", F.lit(s).cast("long").alias("step"), F.col("parent").alias("node")), "path-step")
        out = out.unionByName(at)
    return out


def aggregation_depth(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """One row, ``depth``: the hops after which every node that can reach all sources has done so."""
    d = stored(distances(edges, sources), "depth")
    n = sources.select("node").distinct().count()
    far = d.groupBy("node").agg(F.max("dist").alias("far"), F.count("*").alias("c"))
    return far.where(F.col("c") == n).agg(F.coalesce(F.max("far"), F.lit(0)).cast("long").alias("depth"))


def farthest_anchors(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``(i, node)``: a hashed node, then again and again the node with the most hops to all before it, the smallest of equals."""
    from edgeloom.operators.edges import key, nodes

    e = stored(edges.select("u", "v"), "anchor-edges")
    first = nodes(e).orderBy(key("node", seed=seed), "node").limit(1).collect()
    picked = [r["node"] for r in first]
    while picked and len(picked) < k:
        far = nearest_source(e, e.sparkSession.createDataFrame([(p,) for p in picked], "node long"))
        best = far.orderBy(F.col("dist").desc(), "node").first()
        if best["dist"] <= 0:
            break
        picked.append(best["node"])
    return e.sparkSession.createDataFrame(list(enumerate(picked)), "i long, node long")


def anchor_task(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(node, y)``: the place, by id, of the anchor that is nearest to each node, the first of equals; anchors have -1."""
    order = anchors.select("node").distinct().withColumn("y", F.row_number().over(Window.orderBy("node")).cast("long") - 1)
    near = nearest_source(edges, anchors).join(F.broadcast(order.withColumnRenamed("node", "source")), "source")
    return near.select("node", F.when(F.col("dist") == 0, F.lit(-1).cast("long")).otherwise(F.col("y")).alias("y"))


def global_sign_task(edges: DataFrame, sources: int = 16, seed: int = 0, scale: float = 10.0) -> DataFrame:
    """``(node, x0, x1, y)``: hashed sources, odd in number, hold a hashed bit of their own and a mark; all others are asked for the sign of the sum."""
    from edgeloom.operators.edges import key, nodes

    n = stored(nodes(edges), "sign-nodes")
    k = max(1, (min(sources, n.count() - 1) - 1) | 1)
    bit = F.when(key("node", seed=seed + 1) < "8", 1).otherwise(-1)
    s = stored(n.orderBy(key("node", seed=seed), "node").limit(k).withColumn("b", bit), "sign-sources")
    total = F.broadcast(s.agg((F.sum("b") > 0).cast("long").alias("sign")))
    out = n.join(F.broadcast(s), "node", "left").crossJoin(total)
    held = F.col("b").isNotNull()
    return out.select("node", F.coalesce(F.col("b") * F.lit(scale), F.lit(0.0)).alias("x0"), F.when(held, F.lit(scale)).otherwise(F.lit(0.0)).alias("x1"), F.when(held, F.lit(-1).cast("long")).otherwise(F.col("sign")).alias("y"))


def keyed_retrieval_task(edges: DataFrame, sources: int = 15, seed: int = 0, scale: float = 10.0) -> DataFrame:
    """``(node, x, y, asked)``: each of k hashed sources holds a hashed bit, every other node is asked for the bit of one source that its key names.

    ``x`` has 2 k + 1 places: the source's own number, its bit as a sign, and the number that is asked for. Sources have y = -1 and ask for none.
    At most half of the nodes become sources.
    """
    from edgeloom.operators.edges import key, nodes

    n = stored(nodes(edges), "keyed-nodes")
    k = int(min(sources, max(n.count() // 2, 1)))
    first = n.orderBy(key("node", seed=seed), "node").limit(k)
    j = F.row_number().over(Window.orderBy(key("node", seed=seed), "node")) - 1  # k rows
    s = stored(first.select("node", j.alias("j"), (key("node", seed=seed + 1) < "8").cast("long").alias("bit")), "keyed-sources")
    own = n.join(F.broadcast(s), "node", "left")
    asks = F.when(F.col("j").isNull(), (F.conv(F.substring(key("node", seed=seed + 2), 1, 8), 16, 10).cast("long") % k).cast("int"))
    out = own.withColumn("asks", asks).join(F.broadcast(s.select(F.col("node").alias("asked"), F.col("j").alias("asks"), F.col("bit").alias("answer"))), "asks", "left")
    place = lambda i: F.when((i == F.col("j")) | (i == F.col("asks") + k + 1), F.lit(float(scale))).when((i == k) & F.col("j").isNotNull(), (2 * F.col("bit") - 1) * F.lit(float(scale))).otherwise(F.lit(0.0))
    return out.select("node", F.transform(F.sequence(F.lit(0), F.lit(2 * k)), place).alias("x"), F.coalesce("answer", F.lit(-1).cast("long")).alias("y"), "asked")


class Forest:
    """A rooted forest in arrays: node ids ascending, parent, depth, root, tin and size; roots are the smallest ids."""

    def __init__(self, u: np.ndarray, v: np.ndarray, extra: np.ndarray | None = None):
        ends = np.concatenate([u, v]) if extra is None else np.concatenate([u, v, extra])
        self.ids, index = np.unique(ends, return_inverse=True)
        n, m = len(self.ids), len(u)
        i, j = index[:m], index[m : 2 * m]
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        start = np.searchsorted(src, np.arange(n + 1))
        self.parent, self.depth, self.root = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        levels = []
        from edgeloom.operators.components import smallest_labels

        nodes, low = smallest_labels(i, j) if m else (np.empty(0, int), np.empty(0, int))
        comp = np.arange(n)
        comp[nodes] = low
        at = np.flatnonzero(comp == np.arange(n))
        self.depth[at], self.root[at] = 0, at
        while len(at):
            levels.append(at)
            many = start[at + 1] - start[at]
            e = np.cumsum(many)
            if not len(e) or not e[-1]:
                break
            frm = np.repeat(at, many)
            to = dst[np.repeat(start[at] - e + many, many) + np.arange(e[-1])]
            new = self.depth[to] < 0
            frm, to = frm[new], to[new]
            self.parent[to], self.depth[to], self.root[to] = frm, self.depth[frm] + 1, self.root[frm]
            at = to
        self.levels = levels
        self.size = np.ones(n, np.int64)
        for at in reversed(levels[1:]):
            np.add.at(self.size, self.parent[at], self.size[at])
        self.tin = np.zeros(n, np.int64)
        roots = levels[0] if levels else np.empty(0, int)
        self.tin[roots] = np.cumsum(self.size[roots]) - self.size[roots]
        for at in levels[1:]:
            at = at[np.lexsort((at, self.parent[at]))]
            p = self.parent[at]
            run = np.cumsum(self.size[at]) - self.size[at]
            first = np.flatnonzero(np.diff(p, prepend=-1))
            self.tin[at] = self.tin[p] + 1 + run - np.repeat(run[first], np.diff(first, append=len(at)))
        self._up = None

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, nodes)

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lowest common ancestors of places, -1 between trees."""
        if self._up is None:
            up = [np.where(self.parent < 0, np.arange(len(self.ids)), self.parent)]
            while (up[-1] != up[-1][up[-1]]).any():
                up.append(up[-1][up[-1]])
            self._up = up
        out = np.full(len(a), -1)
        same = self.root[a] == self.root[b]
        x, y = a[same], b[same]
        swap = self.depth[x] < self.depth[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        gap = self.depth[x] - self.depth[y]
        for k, up in enumerate(self._up):
            x = np.where(gap >> k & 1, up[x], x)
        for up in reversed(self._up):
            go = up[x] != up[y]
            x, y = np.where(go, up[x], x), np.where(go, up[y], y)
        out[same] = np.where(x == y, x, self._up[0][x])
        return out

    def subtree(self, values: np.ndarray) -> np.ndarray:
        """Sums over each node's subtree."""
        out = values.copy()
        for at in reversed(self.levels[1:]):
            np.add.at(out, self.parent[at], out[at])
        return out

    def down(self, values: np.ndarray, with_root: bool) -> np.ndarray:
        """Sums from the root to each node, the root's own value only on request."""
        out = values.copy()
        if not with_root and self.levels:
            out[self.levels[0]] = 0
        for at in self.levels[1:]:
            out[at] += out[self.parent[at]]
        return out
