"""Scores of the edges a forest leaves out: how long, and how crowded, is the path that replaces each.

Congestion is counted in closed form: an omitted edge adds 1 at both its ends and takes 2 at their lowest common
ancestor, and a subtree sum gives how many paths cross each forest edge. Path sums of powers come from sums
towards the root. The forest, which has one row a node, is held in arrays and broadcast, up to
TREE_NODES nodes; edges, which are many, stay distributed, and all of them are scored in two passes. Beyond
TREE_NODES the same terms come from Euler tours in tables (``euler``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scoring import EPS, support_score
from edgeloom.operators.paths import Forest
from edgeloom.session import stored

#: The size bound of a broadcast forest (seven arrays of 8 bytes a node).
TREE_NODES = 2_000_000


def forest_arrays(forest: DataFrame, among: DataFrame | None = None) -> Forest:
    """The forest in arrays, refused beyond TREE_NODES edges."""
    t = forest.select("u", "v").limit(TREE_NODES + 1).toArrow()
    if len(t) > TREE_NODES:
        raise ValueError(f"the forest has more than {TREE_NODES} edges; score its clusters one by one")
    extra = None
    if among is not None:
        extra = among.select("node").distinct().limit(TREE_NODES + 2).toArrow().column("node").to_numpy()
        if len(extra) > TREE_NODES + 1:
            raise ValueError(f"the graph has more than {TREE_NODES + 1} nodes; index its clusters one by one")
    return Forest(t.column("u").to_numpy(), t.column("v").to_numpy(), extra)


def index_table(spark, f: Forest) -> DataFrame:
    """``(node, parent, depth, root, tin)``; a root has no parent."""
    parent = pa.array(np.where(f.parent < 0, 0, f.ids[f.parent]) if len(f.ids) else np.empty(0, np.int64), mask=f.parent < 0)
    return spark.createDataFrame(pa.table({"node": f.ids, "parent": parent, "depth": f.depth, "root": f.ids[f.root] if len(f.ids) else f.ids, "tin": f.tin}))


def congestion(spark, candidates: DataFrame, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """``(eCon, vCon)`` by node: paths over the edge to its parent, and paths that pass through it."""
    held = spark.sparkContext.broadcast((f.ids, f.parent, f.depth, f.root))

    def run(batches):
        g = _Light(*held.value)
        for b in batches:
            u, v = g.at(b.column("u").to_numpy()), g.at(b.column("v").to_numpy())
            l = g.lca(u, v)
            u, v, l = u[l >= 0], v[l >= 0], l[l >= 0]
            n = len(g.ids)
            ends = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
            tops = np.bincount(l, minlength=n)
            some = np.flatnonzero(ends + tops)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(ends[some]), pa.array(tops[some])], ["i", "ends", "tops"])

    rows = candidates.select("u", "v").mapInArrow(run, "i long, ends long, tops long").groupBy("i").agg(F.sum("ends").alias("ends"), F.sum("tops").alias("tops")).toArrow()
    ends, tops = np.zeros(len(f.ids), np.int64), np.zeros(len(f.ids), np.int64)
    i = rows.column("i").to_numpy()
    ends[i], tops[i] = rows.column("ends").to_numpy(), rows.column("tops").to_numpy()
    e = f.subtree(ends - 2 * tops)
    return e, e + tops - ends


def tree_paths(candidates: DataFrame, f: Forest) -> DataFrame:
    """``(u, v, pos, node)``: the nodes of the tree path from u to v, in order; no rows for edges between trees."""
    held = candidates.sparkSession.sparkContext.broadcast((f.ids, f.parent, f.depth, f.root))

    def run(batches):
        g = _Light(*held.value)
        for b in batches:
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            i, j = g.at(u), g.at(v)
            top = g.lca(i, j)
            rows: list[list] = [[], [], [], []]
            for k in np.flatnonzero(top >= 0):
                left, right = [i[k]], []
                while left[-1] != top[k]:
                    left.append(g.parent[left[-1]])
                at = j[k]
                while at != top[k]:
                    right.append(at)
                    at = g.parent[at]
                path = g.ids[np.array(left + right[::-1])]
                rows[0] += [u[k]] * len(path)
                rows[1] += [v[k]] * len(path)
                rows[2] += range(len(path))
                rows[3] += path.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["u", "v", "pos", "node"])

    return candidates.select("u", "v").mapInArrow(run, "u long, v long, pos long, node long")


class _Light(Forest):
    """What the lookup of common ancestors needs of a forest."""

    def __init__(self, ids, parent, depth, root):
        self.ids, self.parent, self.depth, self.root, self._up = ids, parent, depth, root, None


def path_terms(edges: DataFrame, forest: DataFrame, p: float = 2.0, q: float = 2.0, weight: str | None = None) -> tuple[DataFrame, Forest, np.ndarray, np.ndarray]:
    """Omitted edges with ``hops, dil, ep, vp, mandatory``, and the forest with its congestions.

    Edges between trees are ``mandatory``: they have no path and count nowhere.
    """
    spark = edges.sparkSession
    f = forest_arrays(forest)
    rest = edges.join(forest.select("u", "v"), ["u", "v"], "left_anti")
    rest = stored(rest.withColumn("__w", F.greatest(F.col(weight), F.lit(EPS)) if weight else F.lit(1.0)), "score-rest")
    known = spark.sparkContext.broadcast(f.ids)

    def both_known(batches):
        ids = known.value
        for b in batches:
            ok = np.isin(b.column("u").to_numpy(), ids) & np.isin(b.column("v").to_numpy(), ids)
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], ["u", "v"])

    e_con, v_con = congestion(spark, rest.select("u", "v").mapInArrow(both_known, "u long, v long"), f)
    sp = f.down((e_con + EPS) ** p, with_root=False)
    nq = f.down((v_con + EPS) ** q, with_root=True)
    held = spark.sparkContext.broadcast((f.ids, f.parent, f.depth, f.root, sp, nq, (v_con + EPS) ** q))

    def run(batches):
        ids, parent, depth, root, sp, nq, vq = held.value
        g = _Light(ids, parent, depth, root)
        for b in batches:
            a, c = b.column("u").to_numpy(), b.column("v").to_numpy()
            n = len(b)
            ok = np.isin(a, ids) & np.isin(c, ids)
            out = {k: np.full(n, np.nan) for k in ("dil", "ep", "vp")}
            hops = np.zeros(n, np.int64)
            u, v = g.at(a[ok]), g.at(c[ok])
            l = g.lca(u, v)
            joined = np.flatnonzero(ok)[l >= 0]
            u, v, l = u[l >= 0], v[l >= 0], l[l >= 0]
            h = depth[u] + depth[v] - 2 * depth[l]
            hops[joined] = h
            out["dil"][joined] = h / b.column("__w").to_numpy()[joined]
            out["ep"][joined] = (np.maximum(0, sp[u] + sp[v] - 2 * sp[l]) / (h + EPS)) ** (1 / p)
            out["vp"][joined] = (np.maximum(0, nq[u] + nq[v] - 2 * nq[l] + vq[l] - vq[u] - vq[v]) / (h - 1 + EPS)) ** (1 / q)
            none = np.ones(n, bool)
            none[joined] = False
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(hops), *[pa.array(out[k], mask=none) for k in ("dil", "ep", "vp")], pa.array(none)], ["u", "v", "hops", "dil", "ep", "vp", "mandatory"])

    terms = rest.select("u", "v", "__w").mapInArrow(run, "u long, v long, hops long, dil double, ep double, vp double, mandatory boolean")
    return stored(terms, "score-terms"), f, e_con, v_con


def terms_of(edges: DataFrame, forest: DataFrame, p: float = 2.0, q: float = 2.0, weight: str | None = None) -> DataFrame:
    """The terms of ``path_terms``: from arrays up to TREE_NODES forest edges, from tables beyond."""
    from edgeloom.operators import euler

    if forest.limit(TREE_NODES + 1).count() > TREE_NODES:
        return euler.path_terms(edges, forest, p, q, weight)
    return path_terms(edges, forest, p, q, weight)[0]


def tree_score(edges: DataFrame, forest: DataFrame, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 1.0, p: float = 2.0, q: float = 2.0, weight: str | None = None) -> DataFrame:
    """``(u, v, hops, dil, ep, vp, mandatory, score)`` of every edge outside the forest; mandatory edges have no score."""
    return scored(terms_of(edges, forest, p, q, weight), alpha, beta_e, beta_v)


def scored(terms: DataFrame, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 1.0) -> DataFrame:
    """Adds ``score`` to terms of edges, each term as a part of the largest."""
    tops = terms.agg(F.coalesce(F.max("dil"), F.lit(0.0)).alias("__d"), F.coalesce(F.max("ep"), F.lit(0.0)).alias("__e"), F.coalesce(F.max("vp"), F.lit(0.0)).alias("__v"))
    score = support_score(F.col("dil"), F.col("ep"), F.col("vp"), F.col("__d"), F.col("__e"), F.col("__v"), alpha, beta_e, beta_v)
    return terms.crossJoin(F.broadcast(tops)).withColumn("score", score).drop("__d", "__e", "__v")
