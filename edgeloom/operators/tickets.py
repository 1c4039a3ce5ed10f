"""Masks found in rounds: drop a share, score what is left anew, rewind; and projections onto a budget by alternating directions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edges import degree, with_ends
from edgeloom.operators.order import top
from edgeloom.session import dropped, stored


def by_degree(left: DataFrame) -> DataFrame:
    """Adds ``s``: the weight of an edge, as it was at the start, over the root of the degrees that its ends have left."""
    return with_ends(left, degree(left), "deg").withColumn("s", F.col("w0") / F.sqrt(F.col("deg_u") * F.col("deg_v"))).drop("deg_u", "deg_v")


def lottery(edges: DataFrame, q: int, rate: float = 0.05, scoring: Callable[[DataFrame], DataFrame] = by_degree, weight: str = "w") -> DataFrame:
    """``(u, v)``: q edges, found in rounds that each drop ``rate`` of what is left (one at least, never below q), lowest scores first.

    Before each round all that is left stands again as it did at the start (``w0``, the size of its weight), and ``scoring`` adds ``s`` to the table
    ``(u, v, w0)`` from what is left, so scores change as the graph does. Ties go by (u, v). Missing weights and scores count as lowest.
    """
    left = stored(edges.select("u", "v", F.abs(F.col(weight)).cast("double").alias("w0")), "ticket")
    n = left.count()
    while n > q:
        n = max(q, n - max(1, int(rate * n)))
        kept = stored(top(scoring(left), [F.col("s").desc_nulls_last(), F.col("u"), F.col("v")], n).select("u", "v", "w0"), "ticket")
        dropped(left)
        left = kept
    return left.select("u", "v")


def admm(edges: DataFrame, q: int, rho: float = 1.0, rounds: int = 8, weight: str = "w") -> DataFrame:
    """``(u, v)``: the q edges whose weights are largest after ``rounds`` of alternating directions towards a table with q weights that are not 0.

    Each round projects weights plus duals onto the q largest, adds what is off to the duals, and draws the weights to their start
    and, with ``rho``, to the projection. Ties go by (u, v); missing weights are 0.
    """
    t = stored(edges.select("u", "v", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("s")).withColumns({"w": F.col("s"), "d": F.lit(0.0)}), "admm")
    for _ in range(rounds):
        best = top(t.select("u", "v", F.abs(F.col("w") + F.col("d")).alias("a")), [F.col("a").desc(), F.col("u"), F.col("v")], q).select("u", "v", F.lit(True).alias("in"))
        z = t.join(best, ["u", "v"], "left").withColumn("z", F.when(F.col("in"), F.col("w") + F.col("d")).otherwise(0.0)).withColumn("d", F.col("d") + F.col("w") - F.col("z"))
        nxt = stored(z.select("u", "v", "s", ((F.col("s") + rho * (F.col("z") - F.col("d"))) / (1 + rho)).alias("w"), "d"), "admm")
        dropped(t)
        t = nxt
    return top(t, [F.abs(F.col("w")).desc(), F.col("u"), F.col("v")], q).select("u", "v")
