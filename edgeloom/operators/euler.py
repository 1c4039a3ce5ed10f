"""Forests of any size in tables: Euler tours by list ranking, sums over subtrees and paths, and common ancestors.

Every edge of a forest is two arcs. Sorted by their ends, arc ``(a, b)`` is followed by the arc of ``b`` after ``(b, a)``, the first after the last,
which makes each tree a circle; cut before the first arc of its root (the smallest node) it is a tour. Doubling the pointers gives each arc
its distance to the end and so its place. A tour has one entry for the root and one for each arc, the node that it comes to. Then

* the sum over a subtree is a difference of two prefix sums of the tour,
* the sum along the path to the root is a prefix sum where arcs that go up take away what the arc down gave,
* the lowest common ancestor of two nodes is the entry of least depth between their first entries: the rest of the one's block, the
  blocks between, and the beginning of the other's. Only the least entry of each block, BLOCKS of them at most, is sent to all tasks.

Prefix sums go over range partitions, so neither driver nor any task holds a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from edgeloom.functions.scoring import EPS
from edgeloom.operators.components import components
from edgeloom.operators.order import running
from edgeloom.session import dropped, stored

#: Blocks of a tour (their least entries are broadcast), and entries of a block at least.
BLOCKS, ENTRIES = 1 << 17, 256


class Tour:
    """``nodes`` (node, parent, root, depth, tin, tout) and ``entries`` (pos, node, child, step, depth) of a forest of canonical edges (u, v)."""

    def __init__(self, forest: DataFrame):
        e = forest.select(F.col("u").alias("src"), F.col("v").alias("dst"))
        arcs = stored(running(e.unionAll(e.select("dst", "src")), [F.col("src"), F.col("dst")], pos="id").select("src", "dst", F.col("id").cast("long").alias("id")), "tour-arcs")
        root = stored(components(forest.select("u", "v")).select("node", F.col("component").alias("root")), "tour-roots")
        ends = arcs.groupBy("src").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("id").alias("rid"))
        starts = ends.join(root.where("node = root").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("first").alias("next"), F.lit(True).alias("start"))
        to = arcs.join(back, ["src", "dst"]).join(ends.withColumnRenamed("src", "dst"), "dst")
        to = to.select("id", F.when(F.col("rid") == F.col("last"), F.col("first")).otherwise(F.col("rid") + 1).alias("next"))
        to = to.join(starts, "next", "left").select("id", F.when(F.col("start").isNull(), F.col("next")).alias("next"))
        ranked = self._ranked(to.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
        placed = arcs.join(ranked, "id").join(root.withColumnRenamed("node", "src"), "src")
        sizes = root.groupBy("root").agg((2 * F.count("*") - 1).alias("entries"))
        starts = running(sizes, [F.col("root")], F.col("entries").cast("double"), cum="upto")
        starts = starts.select("root", "entries", (F.col("upto").cast("long") - F.col("entries")).alias("offset"))
        placed = placed.join(starts, "root").select("root", "src", "dst", (F.col("offset") + F.col("entries") - 1 - F.col("left")).alias("pos"))
        placed = stored(placed, "tour-placed")
        other = placed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("pos").alias("back"))
        both = placed.join(other, ["src", "dst"])
        down = F.col("pos") < F.col("back")
        walk = both.select("pos", F.col("dst").alias("node"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child"), F.when(down, 1).otherwise(-1).alias("step"))
        tops = starts.select(F.col("offset").alias("pos"), F.col("root").alias("node"), F.col("root").alias("child"), F.lit(0).alias("step"))
        deep = running(walk.unionByName(tops), [F.col("pos")], F.col("step").cast("double"), pos="__p", cum="depth").drop("__p")
        self.entries = stored(deep.withColumn("depth", F.col("depth").cast("long")), "tour-entries")
        below = both.where(down).select(F.col("dst").alias("node"), F.col("src").alias("parent"), "root", F.col("pos").alias("tin"), F.col("back").alias("tout"))
        top = starts.select(F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), "root", F.col("offset").alias("tin"), (F.col("offset") + F.col("entries") - 1).alias("tout"))
        found = below.unionByName(top).join(self.entries.where("step >= 0").select(F.col("pos").alias("tin"), "depth"), "tin")
        self.nodes = stored(found.select("node", "parent", "root", "depth", "tin", "tout"), "tour-nodes")
        self.size = self.entries.count()
        dropped(arcs, root, ranked, placed)

    @staticmethod
    def _ranked(to: DataFrame) -> DataFrame:
        """``(id, left)``: steps to the end of its list, by doubling the pointers until all reach it."""
        to = stored(to, "tour-rank")
        while to.where("next IS NOT NULL").limit(1).count():
            far = to.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
            nxt = stored(to.join(far, "next", "left").select("id", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour-rank")
            dropped(to)
            to = nxt
        return to.select("id", "left")

    def _prefix(self, values: DataFrame, value: Column) -> DataFrame:
        """``(pos, cum)`` of a value of entries, which may name columns of ``values`` (child, ...)."""
        e = self.entries.join(values, "child", "left").select("pos", value.alias("y"))
        return running(e, [F.col("pos")], F.coalesce(F.col("y"), F.lit(0.0)), pos="__p").select("pos", "cum")

    def subtree(self, values: DataFrame, column: str) -> DataFrame:
        """``(node, total)``: the sum of a whole-number column of ``values`` (node, ...) over each node and all below it."""
        x = values.select(F.col("node").alias("child"), F.col(column).cast("double").alias("x"))
        cum = stored(self._prefix(x, F.when(F.col("step") >= 0, F.col("x")).otherwise(0.0)), "tour-cum")
        t = self.nodes.join(cum.select(F.col("pos").alias("tin"), F.col("cum").alias("a")), "tin").join(cum.select(F.col("pos").alias("tout"), F.col("cum").alias("b")), "tout")
        own = values.select("node", F.col(column).cast("double").alias("own"))
        return t.join(own, "node", "left").select("node", (F.col("b") - F.col("a") + F.coalesce("own", F.lit(0.0))).cast("long").alias("total"))

    def path(self, values: DataFrame, column: str) -> DataFrame:
        """``(node, total)``: the sum of a column over the nodes from each node up to its root, without the root."""
        x = values.select(F.col("node").alias("child"), F.col(column).cast("double").alias("x"))
        cum = self._prefix(x, F.col("step") * F.col("x"))
        return self.nodes.select("node", "tin").join(cum.withColumnRenamed("pos", "tin"), "tin").select("node", F.col("cum").alias("total"))

    def ancestors(self, pairs: DataFrame) -> DataFrame:
        """Adds ``lca`` to pairs (u, v, ...) of nodes; null where they stand in different trees or one in none."""
        width = max(ENTRIES, -(-self.size // BLOCKS))
        low = F.struct("depth", "node")
        e = self.entries.withColumn("block", F.floor(F.col("pos") / width)).select("pos", "block", low.alias("e"))
        w = Window.partitionBy("block").orderBy("pos")
        e = e.withColumn("begin", F.min("e").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rest", F.min("e").over(w.rowsBetween(0, Window.unboundedFollowing)))
        e = stored(e, "tour-blocks")
        least = e.groupBy("block").agg(F.min("e").alias("e")).select("block", "e.depth", "e.node").toArrow().sort_by("block")  # BLOCKS rows at most
        held = pairs.sparkSession.sparkContext.broadcast((least.column("depth").to_numpy(), least.column("node").to_numpy()))

        def between(a: pa.Array, b: pa.Array) -> pa.Array:
            """The least entry of the blocks after a and before b."""
            depth, node = held.value
            lo, hi = a.to_numpy(zero_copy_only=False) + 1, b.to_numpy(zero_copy_only=False)
            some = np.flatnonzero(hi > lo)
            best = np.zeros(len(lo), np.int64)
            best[some] = _least(depth, lo[some], hi[some])
            none = np.ones(len(lo), bool)
            none[some] = False
            return pa.StructArray.from_arrays([pa.array(depth[best]), pa.array(node[best])], ["depth", "node"], mask=pa.array(none))

        middle = F.arrow_udf(between, "struct<depth: long, node: long>")
        at = self.nodes.select("node", "root", "tin").join(e.select(F.col("pos").alias("tin"), "block", "begin", "rest"), "tin")
        at = stored(at, "tour-at")
        side = lambda s: at.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("root", "tin", "block", "begin", "rest")])
        found = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
        turn = F.col("tin_u") <= F.col("tin_v")
        pick = lambda c, first: F.when(turn == F.lit(first), F.col(f"{c}_u")).otherwise(F.col(f"{c}_v"))
        kept = found.select(*pairs.columns, (F.col("root_u") == F.col("root_v")).alias("__one"), pick("tin", True).alias("__a"), pick("tin", False).alias("__b"), pick("block", True).alias("__x"), pick("block", False).alias("__y"), pick("rest", True).alias("__r"), pick("begin", False).alias("__s"))
        kept = stored(kept, "tour-pairs")
        apart = kept.where("__one AND __x < __y").withColumn("__m", middle("__x", "__y"))
        apart = apart.select(*pairs.columns, F.array_min(F.filter(F.array("__r", "__s", "__m"), lambda x: x.isNotNull()))["node"].alias("lca"))

        def inside(asked: pa.Table, block: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            first = block.column("pos")[0].as_py()
            depth, node = block.column("depth").to_numpy(), block.column("node").to_numpy()
            at = _least(depth, asked.column("__a").to_numpy() - first, asked.column("__b").to_numpy() - first + 1) if len(asked) else np.empty(0, np.int64)
            return pa.table([asked.column("u"), asked.column("v"), pa.array(node[at])], ["u", "v", "lca"])

        same = kept.where("__one AND __x = __y")
        asked = same.select("u", "v", "__a", "__b", F.col("__x").alias("block"))
        entries = e.select(F.col("block").alias("of"), "pos", "e.depth", "e.node").join(asked.select(F.col("block").alias("of")).distinct(), "of", "left_semi")
        near = asked.groupBy("block").cogroup(entries.groupBy("of")).applyInArrow(inside, "u long, v long, lca long")
        same = same.select(*pairs.columns).join(near.distinct(), ["u", "v"])
        none = kept.where("__one IS NULL OR NOT __one").select(*pairs.columns, F.lit(None).cast("long").alias("lca"))
        return stored(apart.unionByName(same.select(*pairs.columns, "lca")).unionByName(none), "tour-lca")


def _least(depth: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the least depth in each [lo, hi), by tables of ranges of powers of two."""
    rows = [np.arange(len(depth))]
    while 2 << (len(rows) - 1) <= len(depth):
        half, last = 1 << (len(rows) - 1), rows[-1]
        a, b = last[: len(last) - half], last[half:]
        rows.append(np.where(depth[b] < depth[a], b, a))
    k = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), np.int64)
    for p in np.unique(k).tolist():
        some = np.flatnonzero(k == p)
        a, b = rows[p][lo[some]], rows[p][hi[some] - (1 << p)]
        out[some] = np.where(depth[b] < depth[a], b, a)
    return out


def congestion(tour: Tour, found: DataFrame) -> DataFrame:
    """``(node, root, depth, e, v)``: tree paths of pairs (u, v, lca) over the edge to a node's parent, and paths that pass through the node."""
    ends = found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("ends"))
    tops = found.groupBy(F.col("lca").alias("node")).agg(F.count("*").alias("tops"))
    have = tour.nodes.select("node", "root", "depth").join(ends, "node", "left").join(tops, "node", "left").na.fill(0, ["ends", "tops"])
    have = stored(have.withColumn("x", F.col("ends") - 2 * F.col("tops")), "score-have")
    con = have.join(tour.subtree(have, "x").withColumnRenamed("total", "e"), "node")
    return con.select("node", "root", "depth", "e", (F.col("e") + F.col("tops") - F.col("ends")).alias("v"))


def path_terms(edges: DataFrame, forest: DataFrame, p: float = 2.0, q: float = 2.0, weight: str | None = None) -> DataFrame:
    """``(u, v, hops, dil, ep, vp, mandatory)`` of the edges outside a forest, as ``tree_score.path_terms`` has them, from tables only."""
    tour = Tour(forest)
    rest = edges.join(forest.select("u", "v"), ["u", "v"], "left_anti")
    rest = rest.select("u", "v", (F.greatest(F.col(weight), F.lit(EPS)) if weight else F.lit(1.0)).alias("w"))
    rest = tour.ancestors(stored(rest, "score-rest"))
    ok = rest.where("lca IS NOT NULL")
    con = congestion(tour, ok).select("node", "root", "depth", F.pow(F.col("e") + EPS, F.lit(p)).alias("ey"), F.pow(F.col("v") + EPS, F.lit(q)).alias("vy"))
    con = stored(con, "score-con")
    crown = con.where("node = root").select("root", F.col("vy").alias("top"))
    sums = con.join(tour.path(con, "ey").withColumnRenamed("total", "sp"), "node").join(tour.path(con, "vy").withColumnRenamed("total", "nq"), "node").join(crown, "root")
    sums = stored(sums.select("node", "depth", "sp", (F.col("nq") + F.col("top")).alias("nq"), "vy"), "score-sums")
    side = lambda s: sums.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("depth", "sp", "nq", "vy")])
    t = ok.join(side("u"), "u").join(side("v"), "v").join(side("lca"), "lca")
    hops = F.col("depth_u") + F.col("depth_v") - 2 * F.col("depth_lca")
    along = F.greatest(F.lit(0.0), F.col("sp_u") + F.col("sp_v") - 2 * F.col("sp_lca"))
    through = F.greatest(F.lit(0.0), F.col("nq_u") + F.col("nq_v") - 2 * F.col("nq_lca") + F.col("vy_lca") - F.col("vy_u") - F.col("vy_v"))
    t = t.withColumn("hops", hops).select(
        "u", "v", "hops", (F.col("hops") / F.col("w")).alias("dil"), F.pow(along / (F.col("hops") + EPS), F.lit(1 / p)).alias("ep"), F.pow(through / (F.col("hops") - 1 + EPS), F.lit(1 / q)).alias("vp"), F.lit(False).alias("mandatory")
    )
    nothing = F.lit(None).cast("double")
    cut = rest.where("lca IS NULL").select("u", "v", F.lit(0).cast("long").alias("hops"), nothing.alias("dil"), nothing.alias("ep"), nothing.alias("vp"), F.lit(True).alias("mandatory"))
    out = stored(t.unionByName(cut), "score-terms")
    dropped(con, sums)
    return out
