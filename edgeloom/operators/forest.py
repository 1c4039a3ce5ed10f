"""Spanning forests under a total order of edges.

With a total order the forest is unique, so it can be found in any sequence: an edge that closes a cycle
among smaller ones of any subset is out. Each partition drops such edges by itself, bounded by the partition. Then
every component takes its smallest edge, components are contracted, and the two steps repeat
until the contracted graph is small enough for one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.components import components
from edgeloom.operators.edges import key
from edgeloom.operators.order import running
from edgeloom.session import dropped, stored

#: Edges of the contracted graph that a single task may hold.
FINISH_EDGES = 1_000_000
#: Edges that a partition holds while it drops those that cannot matter.
HELD_EDGES = 1_000_000


def smallest_forest(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the edges of the forest that is smallest by distinct ranks."""
    order = np.argsort(rank)
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)][order], index[len(a) :][order]
    label = np.arange(len(nodes))
    at = np.arange(len(order))
    taken = []
    while len(at):
        p, q = label[i[at]], label[j[at]]
        at = at[p != q]
        if not len(at):
            break
        p, q = label[i[at]], label[j[at]]
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, p, at)
        np.minimum.at(best, q, at)
        pick = np.unique(best[best < len(order)])
        taken.append(pick)
        x, y = label[i[pick]], label[j[pick]]
        parent = np.arange(len(nodes))
        while True:  # union of what was picked: hook to the smaller end until nothing moves
            u, v = parent[x], parent[y]
            if (u == v).all():
                break
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
            while (parent[parent] != parent).any():
                parent = parent[parent]
        label = parent[label]
    return order[np.concatenate(taken)] if taken else np.empty(0, int)


def _reduced(held: list[pa.RecordBatch]) -> pa.Table:
    t = pa.Table.from_batches(held)
    a, b, r = (t.column(c).to_numpy() for c in ("a", "b", "rank"))
    return t.take(pa.array(np.sort(smallest_forest(a, b, r))))


def _local(batches):
    """Edges without those that close a circle among smaller ones, HELD_EDGES at a time: what stays of them is held on, or handed over if it is much."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= HELD_EDGES:
            t = _reduced(held)
            held, n = t.to_batches(), len(t)
            if 2 * n > HELD_EDGES:
                yield from held
                held, n = [], 0
    if n:
        yield from _reduced(held).to_batches()


def _whole(batches):
    """The forest of all edges at once."""
    held = [b for b in batches if len(b)]
    if held:
        yield from _reduced(held).to_batches()


def spanning_forest(edges: DataFrame, order: list[Column], finish: int = FINISH_EDGES) -> DataFrame:
    """Edges of the forest that Kruskal's scan in this order accepts, with their ``rank`` in it; ties by (u, v)."""
    ranked = stored(running(edges, [*order, F.col("u"), F.col("v")], pos="rank"), "forest-ranked")
    shape = "a long, b long, rank long"
    e = stored(ranked.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("rank").cast("long")).mapInArrow(_local, shape), "forest-edges")
    taken = None
    while True:
        if e.count() <= finish:
            last = e.coalesce(1).mapInArrow(_whole, shape).select("rank")
            break
        ends = e.select(F.explode(F.array("a", "b")).alias("n"), "rank")
        pick = stored(ends.groupBy("n").agg(F.min("rank").alias("rank")).select("rank").distinct(), "forest-pick")
        label = components(e.join(pick, "rank", "left_semi"), "a", "b")
        side = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        nxt = e.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "rank").where("a <> b")
        nxt = stored(nxt.mapInArrow(_local, shape), "forest-edges")
        dropped(e)
        e, taken = nxt, pick if taken is None else taken.unionAll(pick)
    taken = last if taken is None else taken.unionAll(last)
    return ranked.join(stored(taken.distinct(), "forest-taken"), "rank", "left_semi")


def random_forest(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Kruskal's forest in hash order."""
    return spanning_forest(edges, [key("u", "v", seed=seed)])


def bridged_forest(edges: DataFrame, clusters: DataFrame, order: list[Column]) -> DataFrame:
    """Forests within clusters of nodes, (node, cluster), then crossing edges that join their trees, each in the order.

    Inner edges come before all crossing ones, so one forest over that order is both.
    """
    from edgeloom.operators.edges import with_ends

    e = with_ends(edges, clusters, "cluster")
    cross = F.col("cluster_u") != F.col("cluster_v")
    return spanning_forest(e.select(*edges.columns, cross.alias("crosses")), [F.col("crosses"), *order])


def strided_forest(edges: DataFrame, offset: int, stride: int) -> DataFrame:
    """Kruskal's forest scanning edge ``(offset + step * stride) mod m`` at each step; the stride and m have no common factor."""
    e = running(edges, [F.col("u"), F.col("v")], pos="__p")
    m = e.count()
    inverse = pow(stride, -1, m) if m > 1 else 0
    step = F.pmod((F.col("__p") - 1 - offset) * F.lit(inverse), F.lit(max(1, m)))
    return spanning_forest(e.withColumn("__s", step).drop("__p"), [F.col("__s")]).drop("__s")
