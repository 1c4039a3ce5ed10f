"""Supports that keep what a node sees around it: moments of projected features, their residuals, and the cost of one more edge."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions.scoring import dot, norm, spread
from edgeloom.operators.edges import adjacency, degree, nodes
from edgeloom.operators.order import top
from edgeloom.session import dropped, stored


def signs(width: int, dims: int, seed: int) -> list[list[float]]:
    """A sign for each feature and dimension: whether md5 of seed, feature and dimension begins below 8."""
    bit = lambda i, k: 1.0 if hashlib.md5(f"{seed}|{i}|{k}".encode()).hexdigest() < "8" else -1.0
    return [[bit(i, k) for i in range(width)] for k in range(dims)]


def _unit(x):
    n = F.greatest(norm(x), F.lit(1e-12))
    return F.flatten(F.transform(F.array(n), lambda length: F.transform(x, lambda e: e / length)))  # the length is computed once, not for each element


def feature_moments(features: DataFrame, width: int, dims: int = 16, seed: int = 42) -> DataFrame:
    """``(node, x)``: features of length 1, projected by random signs if wider than ``dims``, again of length 1, followed by their squares."""
    f = features.select("node", _unit(F.col("x")).alias("x"))
    if width > dims:
        rows = [F.array(*[F.lit(s / dims**0.5) for s in row]) for row in signs(width, dims, seed)]
        f = f.select("node", F.array(*[dot(F.col("x"), r) for r in rows]).alias("x"))
        f = f.select("node", _unit(F.col("x")).alias("x"))
    return f.select("node", F.concat("x", F.transform("x", lambda e: e * e)).alias("x"))


def neighbour_moments(edges: DataFrame, moments: DataFrame) -> DataFrame:
    """``(node, x)``: the mean of the moments around each node."""
    return spread(adjacency(edges.select("u", "v")).withColumn("w", F.lit(1.0)), moments, "mean")


def residuals(edges: DataFrame, support: DataFrame, targets: DataFrame, moments: DataFrame) -> DataFrame:
    """``(node, deg, target, r)``: the degree in a support, and its sum of moments less the target's share of the graph's mean."""
    zero = F.transform("x", lambda e: F.lit(0.0))
    mean = neighbour_moments(edges, moments).withColumnRenamed("x", "mean")
    have = spread(adjacency(support.select("u", "v")).withColumn("w", F.lit(1.0)), moments, "sum").withColumnRenamed("x", "have")
    d = degree(support, nodes(edges)).join(targets, "node").join(moments, "node").join(mean, "node").join(have, "node", "left")
    r = F.zip_with(F.coalesce("have", zero), "mean", lambda h, m: h - F.col("target") * m)
    return d.select("node", F.col("deg").cast("double").alias("deg"), "target", r.alias("r"))


def addition_costs(candidates: DataFrame, state: DataFrame, moments: DataFrame, weight: float = 1.0) -> DataFrame:
    """``cost`` of adding each candidate to a support with these residuals: the exact change of the squared errors of both its ends."""
    n = state.join(moments, "node")
    side = lambda s: n.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("deg", "target", "r", "x")])
    e = candidates.join(side("u"), "u").join(side("v"), "v")
    t = lambda s: F.greatest(F.col(f"target_{s}"), F.lit(1.0))

    def part(a, b):
        moved = F.aggregate(F.zip_with(f"r_{a}", f"x_{b}", lambda r, x: 2 * r * x + x * x), F.lit(0.0), lambda s, x: s + x)
        return (2 * (F.col(f"deg_{a}") - F.col(f"target_{a}")) + 1 + weight * moved) / (t(a) * t(a))

    return e.select(*candidates.columns, (part("u", "v") + part("v", "u")).alias("cost"))


def balance_objective(state: DataFrame) -> DataFrame:
    """One row: squared relative errors of degrees and of moments, over nodes with a target."""
    t = F.greatest("target", F.lit(1.0))
    moment = F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x) / (t * t)
    return state.where("target > 0").agg(F.sum(F.pow((F.col("deg") - F.col("target")) / t, F.lit(2))).alias("degree_error"), F.sum(moment).alias("moment_error"))


def degree_targets(union: DataFrame, forest: DataFrame, q: int, passes: int = 8, points: int = 16) -> DataFrame:
    """``(node, target)``: the larger of a node's degree in the forest and a share of its degree in the union; the share makes targets sum to 2 q.

    The share is narrowed with sums at ``points`` places a pass, then solved from the nodes that are above their forest's degree.
    """
    d = stored(degree(union).withColumnRenamed("deg", "whole").join(degree(forest).withColumnRenamed("deg", "low"), "node", "left").na.fill(0, ["low"]), "targets")
    low, high = 0.0, max(1.0, 2.0 * q / max(1, d.agg(F.sum("whole")).first()[0] or 1)) * 4
    for _ in range(passes):
        at = [low + (high - low) * k / points for k in range(points + 1)]
        sums = d.agg(*[F.sum(F.greatest(F.col("low"), F.lit(c) * F.col("whole"))) for c in at]).first()
        k = max([i for i, s in enumerate(sums) if (s or 0.0) <= 2.0 * q], default=0)
        low, high = at[k], at[min(points, k + 1)]
    free = F.col("low") <= F.lit((low + high) / 2) * F.col("whole")
    s = d.agg(F.sum(F.when(~free, F.col("low"))).alias("held"), F.sum(F.when(free, F.col("whole"))).alias("whole")).first()
    share = (2.0 * q - (s["held"] or 0)) / s["whole"] if s["whole"] else 0.0
    return d.select("node", F.greatest(F.col("low").cast("double"), F.lit(float(share)) * F.col("whole")).alias("target"))


def disjoint(candidates: DataFrame, k: int) -> DataFrame:
    """``(u, v, cost)``: what a scan in order of (cost, u, v) takes if it passes over edges that touch a node of an edge taken, the first k of these.

    In each round the edges that come first at both of their ends are taken and their nodes leave; that gives the scan's edges, however it is cut.
    """
    free = stored(candidates.select("u", "v", F.round("cost", 9).alias("cost")), "disjoint-free")
    taken = None
    while free.limit(1).count():
        order = F.struct("cost", "u", "v")
        ends = free.select(F.explode(F.array("u", "v")).alias("node"), order.alias("o"))
        new = ends.groupBy("node").agg(F.min("o").alias("o")).groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o.u", "o.v", "o.cost")
        new = stored(new, "disjoint-new")
        taken = new if taken is None else taken.unionByName(new)
        gone = new.select(F.explode(F.array("u", "v")).alias("node"))
        left = stored(free.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v", "cost"), "disjoint-free")
        dropped(free)
        free = left
    return free if taken is None else top(taken, [F.col("cost"), F.col("u"), F.col("v")], k)


def completed(union: DataFrame, forest: DataFrame, q: int, moments: DataFrame, weight: float = 1.0, batch: int | None = None, log: list | None = None) -> DataFrame:
    """``(u, v)``: q edges of a union of supports, its forest among them, that keep degrees and the moments around each node near their targets.

    Each round scores all edges that are left, takes up to ``batch`` of them (an eighth of what is missing if None), vertex-disjoint and cheapest first, and adds what
    they change to the state of their ends. ``moments`` has (node, x) for every node of the union. ``log`` gets the objective before each round and at the end.
    """
    union, kept = stored(union.select("u", "v"), "balance-union"), stored(forest.select("u", "v"), "balance-kept")
    have, m = kept.count(), union.count()
    if have > q:
        raise ValueError(f"a budget of {q} is below a forest of {have} edges")
    q = min(q, m)
    moments = stored(moments.select("node", "x"), "balance-moments")
    state = stored(residuals(union, kept, degree_targets(union, kept, q), moments), "balance-state")
    size = batch or max(1, -(-(q - have) // 8))
    left = stored(union.join(kept, ["u", "v"], "left_anti"), "balance-left")
    while True:
        if log is not None:
            o = balance_objective(state).first()
            log.append((o["degree_error"] or 0.0) + weight * (o["moment_error"] or 0.0))
        if have >= q:
            return kept
        new = stored(disjoint(addition_costs(left, state, moments, weight), min(size, q - have)).select("u", "v"), "balance-new")
        both = new.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(new.select("v", "u"))  # a node stands in one at most
        seen = both.join(moments.select(F.col("node").alias("other"), F.col("x").alias("dx")), "other").select("node", "dx")
        state2 = state.join(seen, "node", "left").select(
            "node", F.when(F.col("dx").isNull(), F.col("deg")).otherwise(F.col("deg") + 1).alias("deg"), "target", F.when(F.col("dx").isNull(), F.col("r")).otherwise(F.zip_with("r", "dx", lambda a, b: a + b)).alias("r")
        )
        state2, kept2, left2 = stored(state2, "balance-state"), stored(kept.unionByName(new), "balance-kept"), stored(left.join(new, ["u", "v"], "left_anti"), "balance-left")
        have += new.count()
        dropped(state, kept, left, new)
        state, kept, left = state2, kept2, left2
