"""Connected components by contraction, without ever gathering an unbounded edge list in one task.

Each round replaces the edges of every partition by a spanning star forest (bounded by the
partition), hooks each node to its smallest neighbour, follows the hooks to their roots by
pointer jumping, and contracts. Components at least halve per round. Once the contracted
graph has at most ``finish`` edges, a bounded size, one task ends it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import dropped, stored

#: Edges of the contracted graph that a single task may hold (about 50 MB with its indexes).
FINISH_EDGES = 500_000


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list, ascending, and the smallest node of each one's component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[i], parent[j]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[parent]
        i, j = i[open_], j[open_]
        lo, hi = np.minimum(p, q)[open_], np.maximum(p, q)[open_]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
    if not a:
        return
    nodes, low = smallest_labels(np.concatenate(a), np.concatenate(b))
    keep = nodes != low
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], ["u", "v"])


def components(edges: DataFrame, u: str = "u", v: str = "v", finish: int = FINISH_EDGES) -> DataFrame:
    """``(node, component)`` for every node of an edge: component is its smallest reachable node.

    Loops and null ends are ignored; repeated and reversed edges change nothing; an edge list
    without edges gives an empty table. Nodes are 64-bit integers.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    e = stored(e.mapInArrow(_stars, "u long, v long"), "cc-edges")
    labels = None
    while True:
        n = e.count()
        if n <= finish:
            roots = e.coalesce(1).mapInArrow(_stars, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
            break
        both = e.union(e.select("v", "u")).toDF("node", "other")
        hook = both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root"))
        hook = stored(hook, "cc-hook")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = stored(hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-jump")
            moved = jumped.where("moved").limit(1).count()
            dropped(hook)
            hook = jumped.drop("moved")
            if not moved:
                break
        a, b = hook.toDF("u", "ru"), hook.toDF("v", "rv")
        contracted = e.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        contracted = stored(contracted.mapInArrow(_stars, "u long, v long"), "cc-edges")
        labels = hook if labels is None else stored(_through(labels, hook), "cc-labels")
        dropped(e)
        e = contracted
    if labels is None:
        labels = roots
    else:
        labels = _through(labels, roots)
    own = labels.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return labels.union(own).groupBy("node").agg(F.min("root").alias("component"))


def _through(labels: DataFrame, roots: DataFrame) -> DataFrame:
    nxt = roots.toDF("root", "next")
    old = labels.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return old.union(roots.join(labels.select("node"), "node", "left_anti"))
