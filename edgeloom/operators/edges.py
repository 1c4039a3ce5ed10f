"""Algebra of edge tables: directed ``(src, dst)``, canonical ``(u, v, w)`` with ``u < v`` and no repeats."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(directed: DataFrame) -> DataFrame:
    """Undirected pairs without loops and repeats."""
    return directed.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of canonical edges."""
    w = ["w"] if "w" in edges.columns else []
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *w).unionAll(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), *w))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def degree(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``(node, deg)``; nodes of ``among`` without an edge have 0."""
    d = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    return d if among is None else among.select("node").join(d, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def with_ends(edges: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """Columns of a node table for both ends, with the suffixes ``_u`` and ``_v``."""
    side = lambda s: values.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return edges.join(side("u"), "u").join(side("v"), "v")


def with_self_loops(adj: DataFrame, among: DataFrame) -> DataFrame:
    """Exactly one loop a node."""
    return adj.where("src <> dst").select("src", "dst").unionAll(among.select(F.col("node").alias("src"), F.col("node").alias("dst")))


def coalesced(edges: DataFrame, how: str = "max") -> DataFrame:
    """Repeated and reversed edges as one: ``max``, ``sum`` or ``avg`` of their weights."""
    f = {"max": F.max, "sum": F.sum, "avg": F.avg}[how]
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(f("w").alias("w"))


def induced(edges: DataFrame, among: DataFrame) -> DataFrame:
    """Edges with both ends in a node set."""
    n = among.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "u"), "u", "left_semi").join(n.withColumnRenamed("node", "v"), "v", "left_semi")


def stats(directed: DataFrame, loops_count: bool = True) -> DataFrame:
    """Rows, undirected pairs and loops of a directed table. ``loops_count``: a loop is an undirected pair too."""
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    if not loops_count:
        pair = F.when(F.col("src") != F.col("dst"), pair)
    return directed.agg(F.count("*").alias("directed"), F.count_distinct(pair).alias("undirected"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))


def edge_ids(edges: DataFrame) -> DataFrame:
    """Adds ``eid``, the place of an edge in ascending (u, v) order, from 0."""
    from edgeloom.operators.order import running

    return running(edges, [F.col("u"), F.col("v")], pos="__p").withColumn("eid", F.col("__p") - 1).drop("__p")


def missing(edges: DataFrame, support: DataFrame) -> DataFrame:
    return edges.join(support.select("u", "v"), ["u", "v"], "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("u", "v"), ["u", "v"], "left_semi")


def budget(m: int, ratio: float, rule: str = "ceil") -> int:
    """Edges to keep. ``ceil``: up, but for a hair; ``round``: half to even, at least 1; ``floor``: down, at least 1."""
    if rule == "ceil":
        return max(0, min(m, math.ceil(ratio * m - 1e-12)))
    if rule == "round":
        return max(1, min(m, int(Decimal(repr(ratio * m)).quantize(Decimal(1), ROUND_HALF_EVEN))))
    return max(1, int(ratio * m))


def checked(support: DataFrame, edges: DataFrame, q: int | None = None) -> DataFrame:
    """One row: what a support must hold — canonical, no repeats, within the graph, finite positive weights, of a size."""
    w = support["w"] if "w" in support.columns else F.lit(1.0)
    s = support.withColumn("__w", w).join(edges.select("u", "v", F.lit(1).alias("__in")), ["u", "v"], "left")
    out = s.agg(
        F.count("*").alias("n"),
        F.count_distinct("u", "v").alias("pairs"),
        F.count(F.when(F.col("u") >= F.col("v"), 1)).alias("not_canonical"),
        F.count(F.when(F.col("__in").isNull(), 1)).alias("foreign_edges"),
        F.count(F.when(~(F.col("__w") > 0) | (F.col("__w") == float("inf")), 1)).alias("bad_weights"),
    )
    return out.withColumn("size_ok", F.lit(True) if q is None else F.col("n") == q)


def balanced_sample(labelled: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k nodes of each part in hash order; the rest of a small part is not filled from others."""
    w = Window.partitionBy("part").orderBy(key("node", seed=seed), "node")
    return labelled.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def key(*cols: str, seed: int = 0):
    """A random order that is the same for every engine and partitioning: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def uniform(*cols: str, seed: int = 0):
    """A number in [0, 1) from the first 13 digits of the key."""
    return F.conv(F.substring(key(*cols, seed=seed), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
