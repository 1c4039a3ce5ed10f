"""Masks of given scores: per-node thresholds calibrated to budgets, and mixtures of experts with noisy gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scoring import gated
from edgeloom.operators.edges import uniform
from edgeloom.operators.order import top
from edgeloom.session import stored

#: Bins of a pass of the calibration; each pass looks into one bin of the pass before.
BINS, PASSES = 512, 4


def standardised(scores: DataFrame, score: str = "s", c: float = 0.01, floor: float = 1e-3, shift: float = 1.0) -> DataFrame:
    """Replaces a score by ``shift + (score - mean) * c / max(deviation, floor)``."""
    mean, off = scores.agg(F.avg(score), F.stddev_pop(score)).first()
    if mean is None:
        return scores
    return scores.withColumn(score, F.lit(shift) + (F.col(score) - F.lit(mean)) * F.lit(c / max(off, floor)))


def calibrated(df: DataFrame, margin: str, order: list[Column], q: int) -> DataFrame:
    """The q rows of largest margin, ties by ``order``, found by narrowing an interval with counts of bins.

    Each pass counts the rows of BINS bins of the interval that holds the q-th margin. Rows above it are in; those inside, few or equal, are put in order.
    """
    n, low, high = df.agg(F.count(margin), F.min(margin), F.max(margin)).first()
    if q <= 0:
        return df.limit(0)
    if n <= q:
        return df.where(F.col(margin).isNotNull())
    left = q
    for _ in range(PASSES):
        if not low < high:
            break
        width = (high - low) / BINS
        if low + width <= low:
            break
        within = df.where((F.col(margin) >= F.lit(low)) & (F.col(margin) <= F.lit(high)))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(margin) - F.lit(low)) / F.lit(width))).cast("int")
        # ends of a bin are those of its rows, so that no row stands between two bins
        counts = within.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(margin).alias("a"), F.max(margin).alias("z")).orderBy(F.col("b").desc()).collect()
        for r in counts:
            if r["n"] >= left:
                low, high = r["a"], r["z"]
                break
            left -= r["n"]
    inside = top(df.where((F.col(margin) >= F.lit(low)) & (F.col(margin) <= F.lit(high))), [F.col(margin).desc(), *order], left)
    return df.where(F.col(margin) > F.lit(high)).unionByName(inside)


def threshold(t: Column, coef: float = 1.0) -> Column:
    """A learned number as a threshold: steep far from 0."""
    return F.lit(coef) * (t * t * t + F.lit(20.0) * t)


def layered_masks(scores: DataFrame, thresholds: DataFrame, budgets: list[int], coef: float = 0.001, tau: float = 0.1, c: float = 0.01) -> DataFrame:
    """``(layer, u, v, soft)``: of each layer as many edges as its budget, all of them in the layer before too.

    ``scores`` has (layer, u, v, s), ``thresholds`` (layer, node, t). Scores of a layer are standardised and held against the threshold of the
    edge's first node; one shift for the whole layer, found by ``calibrated``, makes the budget exact, and ``soft`` is the sigmoid of the margin
    over ``tau``. Nodes without a threshold have 0; edges without a score are left out.
    """
    kept, out = None, None
    for i, q in enumerate(budgets):
        e = standardised(scores.where((F.col("layer") == i) & F.col("s").isNotNull()), c=c).select("u", "v", "s")
        t = thresholds.where(F.col("layer") == i).select(F.col("node").alias("u"), "t")
        e = e.join(t, "u", "left").select("u", "v", (F.col("s") - threshold(F.coalesce("t", F.lit(0.0)), coef)).alias("margin"))
        e = stored(e if kept is None else e.join(kept.select("u", "v"), ["u", "v"], "left_semi"), "mask-margins")
        kept = stored(calibrated(e, "margin", [F.col("u"), F.col("v")], q), "mask")
        rows = kept.select(F.lit(i).cast("long").alias("layer"), "u", "v", (1 / (1 + F.exp(-F.col("margin") / F.lit(tau)))).alias("soft"))
        out = rows if out is None else out.unionByName(rows)
    return out


def hashed_normal(*cols: str, seed: int = 0) -> Column:
    """A normal number from the hashes of some columns."""
    u = lambda k: F.greatest(uniform(*cols, seed=seed + k), F.lit(2.0**-52))
    return F.sqrt(F.lit(-2.0) * F.ln(u(0))) * F.cos(F.lit(2 * math.pi) * u(1))


def hashed_gumbel(*cols: str, seed: int = 0) -> Column:
    u = F.greatest(uniform(*cols, seed=seed), F.lit(2.0**-52))
    return -F.ln(-F.ln(u))


def noisy_gates(nodes: DataFrame, experts: int, k: int, seed: int = 0, noise: float = 1.0) -> DataFrame:
    """``(node, gates)``: softmax over the k largest of an expert's logit plus hashed noise, 0 for the others.

    ``nodes`` has (node, logits, spread), arrays of one number an expert; the noise has the deviation ``softplus(spread) + 0.01``, times ``noise`` (0: none).
    """
    wide = lambda e: F.ln(1 + F.exp(F.col("spread")[e])) + F.lit(0.01)
    noised = F.array(*[F.col("logits")[e] + F.lit(float(noise)) * wide(e) * hashed_normal("node", seed=seed + 2 * e) for e in range(experts)])
    return nodes.select("node", noised.alias("__l")).select("node", gated(F.col("__l"), k).alias("gates"))


def expert_mixture(scores: DataFrame, gates: DataFrame, ratios: list[float], q: int, tau: float = 1.0, gumbel: float = 1.0, seed: int = 0) -> DataFrame:
    """``(u, v, soft)``: q undirected edges, by what the experts of both ends make of them.

    ``scores`` has directed edges (src, dst, experts: one score each). Expert e adds Gumbel noise, times ``gumbel``, takes the softmax over the edges of a
    source, and keeps its best ``ceil(ratio_e * degree)``. A source's gates (node, gates) weigh what the experts keep; both directions are averaged, and
    the q best are taken, ties by (u, v). Sources without gates give 0.
    """
    by_edge = Window.partitionBy("src", "e")
    e = scores.select("src", "dst", F.posexplode("experts").alias("e", "s"))  # the expert dimension, one row each
    e = e.withColumn("x", (F.col("s") + F.lit(float(gumbel)) * hashed_gumbel("src", "dst", "e", seed=seed)) / F.lit(float(tau)))
    e = e.withColumn("z", F.exp(F.col("x") - F.max("x").over(by_edge)))
    e = e.withColumn("p", F.col("z") / F.sum("z").over(by_edge)).withColumn("r", F.row_number().over(by_edge.orderBy(F.col("x").desc(), "dst"))).withColumn("deg", F.count("*").over(by_edge))
    share = F.element_at(F.array(*[F.lit(float(x)) for x in ratios]), F.col("e") + 1)
    e = e.where(F.col("r") <= F.ceil(share * F.col("deg")))
    weighed = e.join(gates.select(F.col("node").alias("src"), "gates"), "src").select("src", "dst", (F.col("gates")[F.col("e")] * F.col("p")).alias("y"))
    pair = scores.select("src", "dst", F.lit(0.0).alias("y")).unionAll(weighed)
    soft = pair.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((F.sum("y") / 2).alias("soft"))
    return top(soft, [F.col("soft").desc(), F.col("u"), F.col("v")], q)
