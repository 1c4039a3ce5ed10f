"""Balanced k-way partitions by levels: match along heavy edges, contract, cut the coarsest graph, refine on the way back.

Coarsening matches nodes along locally dominant edges (the heaviest at both of their ends, ties by hash), never beyond a
bound of size, and contracts the pairs. The coarsest graph is laid out by its modularity clusters and cut into k stretches of
equal size by prefix sums. On the way back to the finest level, nodes on borders move to the part they are tied to most, as far as it has room;
rounds go up and down the numbers of the parts in turn, so neighbours don't swap. A round after which more weight is cut is taken back.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edges import key
from edgeloom.operators.modularity import both_ways, contracted, graph_of, local_moves
from edgeloom.operators.order import running
from edgeloom.session import dropped, stored


def matched(graph: DataFrame, sizes: DataFrame, limit: float, rounds: int = 3, seed: int = 0) -> DataFrame:
    """``(node, cluster)``: pairs of nodes matched along locally dominant edges, named by their smaller node; all others by themselves.

    A pair has at most ``limit`` in ``sizes`` (node, size) together. In each round every free node takes its heaviest edge, and edges taken by both ends match.
    """
    a, b = sizes.toDF("u", "su"), sizes.toDF("v", "sv")
    free = graph.where("u <> v").join(a, "u").join(b, "v").where(F.col("su") + F.col("sv") <= limit).select("u", "v", "w")
    pairs = None
    for r in range(rounds):
        order = F.struct(F.col("w"), key("u", "v", seed=seed + r).alias("h"), F.col("u"), F.col("v"))
        ends = free.select(F.explode(F.array("u", "v")).alias("node"), order.alias("o"))
        taken = ends.groupBy("node").agg(F.max("o").alias("o")).groupBy("o.u", "o.v").agg(F.count("*").alias("n"))
        new = stored(taken.where("n = 2").select("u", "v"), "part-match")
        pairs = new if pairs is None else pairs.unionByName(new)
        if r + 1 < rounds:
            done = new.select(F.explode(F.array("u", "v")).alias("node"))
            free = stored(free.join(done.toDF("u"), "u", "left_anti").join(done.toDF("v"), "v", "left_anti"), "part-free")
    up = pairs.select(F.col("v").alias("node"), F.col("u").alias("cluster"))
    return sizes.join(up, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def stretches(order: DataFrame, k: int, total: float) -> DataFrame:
    """``(node, part)``: nodes in order of (cluster, node) cut into k stretches by the middle of their size; a part exceeds the mean by one node at most."""
    r = running(order, [F.col("cluster"), F.col("node")], F.col("size").cast("double"))
    middle = (F.col("cum") - F.col("size") / 2) * k / F.lit(float(total))
    return r.select("node", "size", F.least(F.lit(k - 1), F.floor(middle)).cast("int").alias("part"))


def cut_weight(graph: DataFrame, parts: DataFrame) -> float:
    """The weight of edges between parts."""
    a, b = parts.select(F.col("node").alias("u"), F.col("part").alias("pu")), parts.select(F.col("node").alias("v"), F.col("part").alias("pv"))
    return graph.join(a, "u").join(b, "v").where("pu <> pv").agg(F.sum("w")).first()[0] or 0.0


def refined(graph: DataFrame, parts: DataFrame, k: int, cap: float, rounds: int = 4) -> DataFrame:
    """``(node, size, part)`` after border nodes moved to parts they are tied to more, none of which comes above ``cap``."""
    adj = stored(both_ways(graph), "part-adj")
    at, best, least = stored(parts.select("node", "size", "part"), "part-at"), None, float("inf")
    for r in range(rounds + 1):
        ties = adj.join(at.select(F.col("node").alias("dst"), F.col("part").alias("p")), "dst").groupBy("src", "p").agg(F.sum("w").alias("w"))
        ties = stored(ties.join(at.select(F.col("node").alias("src"), "size", "part"), "src"), "part-ties")
        cut = (ties.where("p <> part").agg(F.sum("w")).first()[0] or 0.0) / 2
        if cut > least:
            dropped(at)
            at = best
        else:
            if best is not None and best is not at:
                dropped(best)
            best, least = at, cut
        if r == rounds:
            dropped(ties)
            break
        if cut > least:  # the ties of what was taken back
            dropped(ties)
            ties = adj.join(at.select(F.col("node").alias("dst"), F.col("part").alias("p")), "dst").groupBy("src", "p").agg(F.sum("w").alias("w"))
            ties = stored(ties.join(at.select(F.col("node").alias("src"), "size", "part"), "src"), "part-ties")
        onward = F.col("p") > F.col("part") if r % 2 == 0 else F.col("p") < F.col("part")
        here = F.coalesce(F.max(F.when(F.col("p") == F.col("part"), F.col("w"))), F.lit(0.0))
        to = ties.groupBy("src", "size", "part").agg(F.max(F.when(onward, F.struct(F.col("w"), -F.col("p")))).alias("best"), here.alias("here"))
        to = to.where(F.col("best.w") > F.col("here")).select(F.col("src").alias("node"), "size", (-F.col("best.col2")).alias("to"), (F.col("best.w") - F.col("here")).alias("gain"))
        held = at.groupBy("part").agg(F.sum("size").alias("held"))  # k rows, as are the starts below
        queue = running(to, [F.col("to"), F.col("gain").desc(), F.col("node")], F.col("size").cast("double"))
        starts = queue.groupBy("to").agg(F.min(F.col("cum") - F.col("size")).alias("start"))
        room = starts.join(held.withColumnRenamed("part", "to"), "to", "left").select("to", "start", (F.lit(cap) - F.coalesce("held", F.lit(0))).alias("room"))
        go = queue.join(F.broadcast(room), "to").where(F.col("cum") - F.col("start") <= F.col("room")).select("node", "to")
        at = stored(at.join(go, "node", "left").select("node", "size", F.coalesce("to", "part").alias("part")), "part-at")
        dropped(ties)
    dropped(adj)
    return best


def balanced_partition(edges: DataFrame, k: int, slack: float = 0.05, coarsest: int = 40, seed: int = 0) -> DataFrame:
    """``(node, part)``: k parts of at most ``ceil((1 + slack) * nodes / k)`` nodes with little weight between them.

    Edges are canonical, with weights ``w`` or 1 each; loops are ignored, repeats summed; nodes are the ends of edges. Coarsening ends at ``coarsest`` nodes
    a part, or when a level has more than nine tenths of the nodes of the one before. With k = 1 all nodes are one part; with more parts than nodes some stay empty.
    """
    levels = []
    graph = stored(graph_of(edges), "part-graph")
    sizes = stored(graph.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("size", F.lit(1)), "part-sizes")
    n = total = sizes.count()
    if k <= 1 or not n:
        return sizes.select("node", F.lit(0).alias("part"))
    cap = math.ceil((1 + slack) * total / k)
    limit = max(2.0, slack * total / k)  # then stretches stay below the cap
    while n > coarsest * k:
        up = stored(matched(graph, sizes, limit, seed=seed + len(levels)), "part-up")
        fewer = stored(sizes.join(up, "node").groupBy("cluster").agg(F.sum("size").cast("int").alias("size")).withColumnRenamed("cluster", "node"), "part-sizes")
        left = fewer.count()
        if left > 0.9 * n:
            dropped(up, fewer)
            break
        levels.append((graph, up, sizes))
        graph, sizes, n = stored(contracted(graph, up), "part-graph"), fewer, left
    near, _ = local_moves(graph, 6, seed)
    near = sizes.join(near, "node", "left").select("node", "size", F.coalesce("cluster", "node").alias("cluster"))
    parts = refined(graph, stretches(near, k, total), k, cap)
    while levels:
        dropped(graph, sizes)
        graph, up, sizes = levels.pop()
        down = up.join(parts.select(F.col("node").alias("cluster"), "part"), "cluster").join(sizes, "node").select("node", "size", "part")
        parts = refined(graph, down, k, cap)
        dropped(up)
    return parts.select("node", "part")
