"""Choosing edges: exact and per-node top-k, and sampling with reproducible keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import degree, key, uniform
from edgeloom.operators.order import running, top
from edgeloom.session import stored


def top_k(edges: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best by score, ties by (u, v)."""
    return top(edges, [score.desc(), F.col("u"), F.col("v")], k)


def mandatory_first(edges: DataFrame, score: Column, k: int) -> DataFrame:
    """Edges marked ``mandatory`` before all others, then by score, ties by (u, v)."""
    return top(edges, [F.col("mandatory").desc(), score.desc(), F.col("u"), F.col("v")], k)


def per_node(adj: DataFrame, score: Column, k: Column, ties: bool = False) -> DataFrame:
    """Each source's k best edges; with ``ties`` all that equal the k-th."""
    w = Window.partitionBy("src").orderBy(score.desc(), *([] if ties else [F.col("dst")]))
    return adj.withColumn("__r", (F.rank() if ties else F.row_number()).over(w)).where(F.col("__r") <= k).drop("__r")


def one_each(adj: DataFrame, score: Column, k: int) -> DataFrame:
    """Each source's best edge, then the best of the rest to k in all."""
    best = per_node(adj, score, F.lit(1))
    rest = adj.join(best.select("src", "dst"), ["src", "dst"], "left_anti")
    n = best.count()
    return best.unionByName(top(rest, [score.desc(), F.col("src"), F.col("dst")], max(0, k - n)))


def ticket(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k evenly spread edges: places ``floor(i * m / k) + offset`` modulo m."""
    numbered = running(edges, [F.col("u"), F.col("v")], pos="__p")
    m = numbered.count()
    if not m or k <= 0:
        return edges.limit(0)
    k = min(k, m)
    offset = seed * 2654435761 % m
    place = F.pmod(F.col("__p") - 1 - offset, F.lit(m))
    # place is floor(i * m / k) for some i exactly if the next multiple of m / k lies in [place, place + 1)
    i = F.ceil(place * k / m)
    return numbered.where((i < k) & (F.floor(i * m / k) == place)).drop("__p")


def uniform_sample(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k edges without replacement, in hash order."""
    return top(edges, [key("u", "v", seed=seed), F.col("u"), F.col("v")], k)


def bernoulli(edges: DataFrame, p: float, seed: int = 0) -> DataFrame:
    return edges.where(uniform("u", "v", seed=seed) < F.lit(float(p)))


def race(edges: DataFrame, p: Column, k: int, seed: int = 0) -> DataFrame:
    """k edges without replacement in proportion to p: the k smallest of exponential arrival times. Edges with p = 0 never come."""
    arrival = -F.log(1 - uniform("u", "v", seed=seed)) / p
    return top(edges.where(p > 0).withColumn("arrival", F.round(arrival, 9)), [F.col("arrival"), F.col("u"), F.col("v")], k)


def candidate_sample(kept: DataFrame, candidates: DataFrame, k: int, mode: str = "random", seed: int = 0) -> DataFrame:
    """``(u, v)``: which candidates a growth step looks at: all (``full``), at least one and at most k at ``random``, or ``weighted`` by one over
    the degree that each end has in what is kept, so that thin places are looked at sooner."""
    c = candidates.select("u", "v")
    if mode == "full":
        return c
    if mode == "random":
        return uniform_sample(c, max(1, k), seed)
    if mode != "weighted":
        raise ValueError(f"mode {mode}: full, random or weighted")
    deg = degree(kept)
    for end in ("u", "v"):
        c = c.join(deg.select(F.col("node").alias(end), F.col("deg").alias(f"d{end}")), end, "left")
    p = 1 / F.greatest(F.coalesce("du", F.lit(1)), F.lit(1)) + 1 / F.greatest(F.coalesce("dv", F.lit(1)), F.lit(1))
    return race(c.select("u", "v", p.alias("p")), F.col("p"), max(1, k), seed).select("u", "v")


def random_neighbours(adj: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Canonical union of k hashed neighbours of every node."""
    w = Window.partitionBy("src").orderBy(key("src", "dst", seed=seed), "dst")
    kept = adj.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return kept.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def inclusion(pool: DataFrame, pi: str, target: int, out: str = "p") -> DataFrame:
    """Probabilities that sum to ``target``, in proportion to ``pi`` but at most 1.

    The fixed point of capping and dealing again: in descending order of pi the first c are capped, where c is the first
    count with ``pi * (target - c) < rest``; prefix sums find it in one pass. With no mass all are alike.
    """
    n, mass = pool.agg(F.count("*"), F.sum(pi)).first()
    if target >= n or target <= 0:
        return pool.withColumn(out, F.lit(1.0 if n and target >= n else 0.0))
    if not mass:
        return pool.withColumn(out, F.lit(target / n))
    order = [F.col(pi).desc(), *[F.col(c) for c in ("u", "v") if c in pool.columns]]
    r = running(pool, order, F.col(pi), "__i", "__c")
    rest = F.lit(float(mass)) - F.col("__c") + F.col(pi)
    capped = r.where(F.col(pi) * (target - F.col("__i") + 1) >= rest).agg(F.count("*").alias("c"), F.coalesce(F.sum(pi), F.lit(0.0)).alias("s")).first()
    c, s = capped["c"], capped["s"]
    free = mass - s
    scale = (target - c) / free if free > 0 else 0.0
    p = F.when(F.col("__i") <= c, F.lit(1.0)).otherwise(F.least(F.col(pi) * F.lit(scale), F.lit(1.0)))
    return r.withColumn(out, p).drop("__i", "__c")


def systematic(pool: DataFrame, p: str, k: int, offset: float, order: list[Column]) -> DataFrame:
    """Rows in which one of the ticks ``offset + i`` (i below k) lands on the running sum of p; topped up by the largest p."""
    r = running(pool, order, F.col(p), "__i", "__c")
    tick = lambda c: F.greatest(F.lit(-1), F.least(F.floor(F.round(c - F.lit(offset), 9)), F.lit(k - 1)))
    r = r.withColumn("hit", tick(F.col("__c")) > tick(F.col("__c") - F.col(p)))
    got = r.where("hit")
    short = k - got.count()
    if short > 0:
        got = got.unionByName(top(r.where("NOT hit"), [F.col(p).desc(), *order], short))
    return got.drop("__i", "__c", "hit")


def with_replacement(pool: DataFrame, p: str, draws: int, order: list[Column], seed: int = 0) -> DataFrame:
    """``n`` draws of each row out of ``draws``, in proportion to p: hashed points between 0 and the total.

    The points are laid into cells of the running sum, so that each row meets the points of its cells only.
    """
    r = running(pool, order, F.col(p), "__i", "__c")
    total = r.agg(F.sum(p)).first()[0] or 0.0
    cells = max(1, min(draws, 1 << 20))
    spark = pool.sparkSession
    points = spark.range(draws).select((uniform("id", seed=seed) * F.lit(float(total))).alias("t"))
    points = points.withColumn("__cell", F.floor(F.col("t") / F.lit(total / cells)))
    cell = lambda c: F.floor(c / F.lit(total / cells))
    rows = r.withColumn("__lo", F.col("__c") - F.col(p)).withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__c")))))
    hit = rows.join(points, "__cell").where((F.col("t") >= F.col("__lo")) & (F.col("t") < F.col("__c")))
    return hit.groupBy(*pool.columns).agg(F.count("*").alias("n"))


def _draws(rows: DataFrame, total: float, first: int, last: int, cells: int, seed: int) -> DataFrame:
    """``(id, ...)``: the row that each of the hashed points ``first`` to ``last - 1`` falls on."""
    spark = rows.sparkSession
    points = spark.range(first, last).select("id", (uniform("id", seed=seed) * F.lit(float(total))).alias("t"))
    points = points.withColumn("__cell", F.floor(F.col("t") / F.lit(total / cells)))
    return rows.join(points, "__cell").where((F.col("t") >= F.col("__lo")) & (F.col("t") < F.col("__c")))


def until_distinct(pool: DataFrame, p: str, k: int, order: list[Column], seed: int = 0) -> tuple[DataFrame, int]:
    """Rows drawn in proportion to p, one by one, until k different ones have come up: ``n`` draws of each, and the draws in all.

    Draws are hashed points in order of their number; they are made in doubling blocks, and the k-th first appearance tells the
    last draw that counts. An error if fewer than k rows have a chance.
    """
    r = stored(running(pool.where(F.col(p) > 0), order, F.col(p), "__i", "__c"), "distinct-pool")
    able, total = r.count(), r.agg(F.sum(p)).first()[0] or 0.0
    if able < k:
        raise ValueError(f"{k} different rows asked for, {able} have a chance")
    if k <= 0:
        return pool.limit(0).withColumn("n", F.lit(0).cast("long")), 0
    cells = max(1, min(4 * k, 1 << 20))
    cell = lambda c: F.floor(c / F.lit(total / cells))
    rows = r.withColumn("__lo", F.col("__c") - F.col(p)).withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__c")))))
    made, size, hits = 0, 2 * k, None
    while True:
        new = stored(_draws(rows, total, made, made + size, cells, seed).select("id", "__i"), "distinct-draws")
        hits, made, size = new if hits is None else hits.unionByName(new), made + size, made + size
        firsts = hits.groupBy("__i").agg(F.min("id").alias("id"))
        if firsts.count() >= k:
            break
    last = top(firsts, [F.col("id")], k).agg(F.max("id")).first()[0]
    times = hits.where(F.col("id") <= last).groupBy("__i").agg(F.count("*").alias("n"))
    return r.join(times, "__i").select(*pool.columns, "n"), last + 1


def shrinking_masks(scores: DataFrame, budgets: list[int]) -> DataFrame:
    """``(layer, u, v)``: each layer's best edges by ``s`` among those that the layer before it kept, as many as its budget."""
    kept, out = None, None
    for i, q in enumerate(budgets):
        layer = scores.where(F.col("layer") == i)
        layer = layer if kept is None else layer.join(kept, ["u", "v"], "left_semi")
        kept = stored(top(layer, [F.col("s").desc(), F.col("u"), F.col("v")], q).select("u", "v"), "mask")
        rows = kept.select(F.lit(i).cast("long").alias("layer"), "u", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def percentile_pruned(edges: DataFrame, percent: float, weight: str = "w") -> DataFrame:
    """Edges without the ``percent`` smallest: those below the percentile of absolute weights go, then the smallest until ``floor(m * percent / 100)`` are gone."""
    m, low = edges.agg(F.count("*"), F.percentile(F.abs(F.col(weight)), F.lit(percent / 100.0))).first()
    left = edges.where(F.abs(F.col(weight)) >= F.lit(low if low is not None else 0.0))
    n = left.count()
    more = int(m * percent / 100.0) - (m - n)
    return top(left, [F.col(weight).desc(), F.col("u"), F.col("v")], n - more) if more > 0 else left


def across_layers(layers: list[DataFrame], k: int, score: str = "w") -> DataFrame:
    """``(layer, u, v)``: the k best edges of all layers together, ties by layer and edge."""
    rows = None
    for i, e in enumerate(layers):
        r = e.select(F.lit(i).cast("long").alias("layer"), "u", "v", F.col(score).cast("double").alias("s"))
        rows = r if rows is None else rows.unionByName(r)
    return top(rows, [F.col("s").desc(), F.col("layer"), F.col("u"), F.col("v")], k).select("layer", "u", "v")


def fan_out(adj: DataFrame, roots: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """``(hop, src, dst)``: from the roots on, hashed neighbours of each node that is reached, as many a hop as ``sizes`` says."""
    at, out = roots.select(F.col("node").alias("src")).distinct(), None
    for h, k in enumerate(sizes):
        near = adj.select("src", "dst").join(at, "src")
        w = Window.partitionBy("src").orderBy(key("src", "dst", seed=seed + h), "dst")
        hop = stored(near.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).select(F.lit(h).alias("hop"), "src", "dst"), "fan-out")
        out = hop if out is None else out.unionByName(hop)
        at = hop.select(F.col("dst").alias("src")).distinct()
    return out


def walk_norms(trail: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often walks meet nodes and edges: ``(node, norm)`` is the number of walks over those that meet the node, ``(u, v, norm)``
    the walks that meet the smaller end's node over those that have both ends."""
    seen = stored(trail.select("root", "node").distinct(), "walk-nodes")
    walks_ = seen.select("root").distinct().count()
    times = stored(seen.groupBy("node").agg(F.count("*").alias("c")), "walk-times")
    node = times.select("node", (F.lit(float(walks_)) / F.col("c")).alias("norm"))
    both = edges.select("u", "v").join(seen.withColumnRenamed("node", "u"), "u").join(seen.withColumnRenamed("node", "v"), ["v", "root"]).groupBy("u", "v").agg(F.count("*").alias("b"))
    edge = both.join(times.withColumnRenamed("node", "u"), "u").select("u", "v", (F.col("c") / F.col("b")).alias("norm"))
    return node, edge


def walks(adj: DataFrame, roots: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``(root, step, node)``: hashed random walks; a step goes to the neighbour with the smallest key."""
    out = at = roots.select(F.col("node").alias("root"), F.lit(0).alias("step"), "node")
    w = Window.partitionBy("root").orderBy("__k", "dst")
    for s in range(1, length + 1):
        nxt = at.join(adj.select(F.col("src").alias("node"), "dst"), "node").withColumn("__k", key("root", "step", "dst", seed=seed))
        at = nxt.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("root", F.lit(s).alias("step"), F.col("dst").alias("node"))
        out = out.unionByName(at)
    return out
