"""Views of one graph combined: identity, bank, consensus, budgeted union, balanced completion, sampling weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import degree, nodes, with_ends
from edgeloom.operators.forest import random_forest, spanning_forest
from edgeloom.operators.order import average_percentile, top
from edgeloom.operators.select import inclusion, systematic
from edgeloom.operators.euler import Tour
from edgeloom.operators.tree_score import TREE_NODES, forest_arrays, terms_of, tree_score
from edgeloom.session import stored

#: Labels of a frozen model, and views of a bank that it judges.
ROWS = 10_000
#: Edges that a task of the balanced completion holds, and that it sorts in a round.
POOL, FRONT = 1_000_000, 16_384


def support_ids(views: DataFrame, view: str = "view_id") -> DataFrame:
    """``(view, support_id, n)``: a hash of each view's edges in order.

    Equal supports have equal ids. The ordered text of a view is one value, so this suits supports of a bank.
    """
    e = F.array_sort(F.collect_list(F.struct("u", "v")))
    text = F.array_join(F.transform(e, lambda x: F.concat_ws("-", x["u"].cast("string"), x["v"].cast("string"))), ",")
    return views.groupBy(view).agg(F.sha2(text.cast("binary"), 256).alias("support_id"), F.count("*").alias("n"))


def bank(records: DataFrame, k: int, distinct: bool = True) -> DataFrame:
    """The k best views by (score, epoch), of equal supports one."""
    if distinct:
        w = Window.partitionBy("support_id").orderBy(F.col("score").desc(), F.col("epoch").desc(), "view_id")
        records = records.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return records.orderBy(F.col("score").desc(), F.col("epoch").desc(), "view_id").limit(k)


def _one_row(small: DataFrame) -> DataFrame:
    """All rows of a small table in one, ``rows``; refused above ROWS."""
    if small.limit(ROWS + 1).count() > ROWS:
        raise ValueError(f"more than {ROWS} rows")
    return F.broadcast(small.agg(F.collect_list(F.struct(*small.columns)).alias("rows")))


def reranked(views: DataFrame, nodes: DataFrame, model: DataFrame) -> DataFrame:
    """``(view_id, accuracy, rank)``: views of a bank judged again by one frozen model.

    The model is linear, ``(label, c)`` with a row of weights for each label, over the mean of a node and its neighbours in the view.
    Nodes ``(node, x, y)`` are multiplied with the weights once, before they are joined to the edges, so a view costs as many numbers an edge as
    there are labels. The highest mean wins, of equal ones the smallest label; ranks go by accuracy, then view. Nodes without a label don't count.
    Labels and views are refused above ROWS of either.
    """
    dot = F.aggregate(F.zip_with("x", "c", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    logits = nodes.crossJoin(_one_row(model.select("label", "c"))).select("node", "x", F.inline("rows"))
    logits = stored(logits.select(F.col("node").alias("dst"), "label", dot.alias("s")), "frozen")
    both = views.select("view_id", F.col("u").alias("src"), F.col("v").alias("dst")).unionAll(views.select("view_id", "v", "u"))
    own = nodes.select("node").crossJoin(_one_row(views.select("view_id").distinct())).select("node", F.inline("rows"))
    own = own.select("view_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    mean = both.unionAll(own).join(logits, "dst").groupBy("view_id", F.col("src").alias("node"), "label").agg(F.round(F.avg("s"), 9).alias("s"))
    best = mean.groupBy("view_id", "node").agg(F.max_by("label", F.struct(F.col("s"), -F.col("label"))).alias("pred"))
    right = best.join(nodes.where("y >= 0").select("node", "y"), "node").groupBy("view_id").agg(F.round(F.avg((F.col("pred") == F.col("y")).cast("double")), 9).alias("accuracy"))
    return right.withColumn("rank", F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "view_id")).cast("long"))  # one row a view


def occurrences(views: DataFrame) -> DataFrame:
    return views.groupBy("u", "v").agg(F.count("*").alias("times"))


def consensus(views: DataFrame, q: int, lam: float = 0.5, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 0.0) -> DataFrame:
    """q edges: a forest of the most frequent, then by percentile of tree score on the union mixed with frequency.

    An error if the forest is above q or the union has fewer than q edges.
    """
    k = views.select("view_id").distinct().count()
    union = stored(occurrences(views), "consensus-union")
    forest = stored(spanning_forest(union, [F.col("times").desc()]).select("u", "v"), "consensus-forest")
    f, m = forest.count(), union.count()
    if f > q or m < q:
        raise ValueError(f"a budget of {q} does not fit a forest of {f} edges and a union of {m}")
    scored = tree_score(union.select("u", "v"), forest, alpha, beta_e, beta_v).where("NOT mandatory")
    scored = average_percentile(scored.withColumn("raw", F.round("score", 9)), "raw").join(union, ["u", "v"])
    scored = scored.withColumn("combined", F.round((1 - lam) * F.col("pct") + lam * F.col("times") / k, 9))
    rest = top(scored, [F.col("combined").desc(), F.col("raw").desc(), F.col("u"), F.col("v")], q - f)
    return forest.withColumn("origin", F.lit("forest")).unionByName(rest.select("u", "v", F.lit("ranked").alias("origin")))


def budgeted_union(views: DataFrame, edges: DataFrame, q: int, alpha: float = 1.0, beta_e: float = 1.0) -> DataFrame:
    """q edges of the union: a forest of the most frequent, then repeated edges by frequency, then the rest by tree score on the graph."""
    union = stored(occurrences(views), "union")
    forest = stored(spanning_forest(union, [F.col("times").desc()]).select("u", "v"), "union-forest")
    f, m = forest.count(), union.count()
    if f > q:
        raise ValueError(f"a budget of {q} is below a forest of {f} edges")
    rest = union.join(forest, ["u", "v"], "left_anti")
    if m > q:
        score = tree_score(edges.select("u", "v"), forest, alpha, beta_e, 0.0).select("u", "v", F.round("score", 9).alias("score"))
        rest = rest.join(score, ["u", "v"], "left")
        order = [(F.col("times") > 1).desc(), F.when(F.col("times") > 1, F.col("times")).otherwise(0).desc(), F.col("score").desc(), F.col("u"), F.col("v")]
        rest = top(rest, order, q - f)
    return forest.unionByName(rest.select("u", "v"))


def sample_weights(edges: DataFrame, forests: int = 8, lam: float = 1.0, seed: int = 0, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 0.0) -> DataFrame:
    """``(u, v, frequency, support, pi, mandatory)``: how often random forests have an edge, plus its mean share of their scores."""
    total = edges.select("u", "v", F.lit(0.0).alias("frequency"), F.lit(0.0).alias("support"), F.lit(False).alias("mandatory"))
    for r in range(forests):
        f = stored(random_forest(edges, seed + 1000 * (r + 1)).select("u", "v"), "sample-forest")
        s = tree_score(edges.select("u", "v"), f, alpha, beta_e, beta_v)
        s = s.crossJoin(F.broadcast(s.agg(F.coalesce(F.sum("score"), F.lit(1.0)).alias("__t"))))
        s = s.select("u", "v", F.lit(0.0).alias("frequency"), (F.coalesce("score", F.lit(0.0)) / F.greatest(F.col("__t"), F.lit(1e-300)) / forests).alias("support"), "mandatory")
        total = total.unionByName(f.select("u", "v", F.lit(1.0 / forests).alias("frequency"), F.lit(0.0).alias("support"), F.lit(False).alias("mandatory"))).unionByName(s)
    out = total.groupBy("u", "v").agg(F.sum("frequency").alias("frequency"), F.sum("support").alias("support"), F.max("mandatory").alias("mandatory"))
    return stored(out.withColumn("pi", F.greatest(F.col("frequency") + lam * F.col("support"), F.lit(1e-8))), "sample-weights")


def mixture(pool: DataFrame, a: float = 0.5) -> DataFrame:
    """``pi`` of a pool as a mix of its frequencies and supports, each as shares; at least 1e-8 of an even share."""
    t = pool.agg(F.sum("frequency").alias("__f"), F.sum("support").alias("__s"), F.count("*").alias("__n"))
    share = lambda c, s: F.when(F.col(s) > 0, F.col(c) / F.col(s)).otherwise(F.lit(0.0))
    mix = (1 - a) * share("frequency", "__f") + a * share("support", "__s")
    return pool.crossJoin(F.broadcast(t)).withColumn("pi", F.greatest(mix, F.lit(1e-8) / F.col("__n"))).drop("__f", "__s", "__n")


def _near(pool: DataFrame, forest: DataFrame) -> DataFrame:
    """Adds ``near``, where the lowest common ancestor of an edge's ends stands in its forest; -1 between trees."""
    if forest.limit(TREE_NODES + 1).count() > TREE_NODES:
        tour = Tour(forest)
        at = tour.nodes.select(F.col("node").alias("lca"), F.col("tin").alias("near"))
        return tour.ancestors(pool).join(at, "lca", "left").select("u", "v", "pi", F.coalesce("near", F.lit(-1)).alias("near"))
    f = forest_arrays(forest)
    held = pool.sparkSession.sparkContext.broadcast((f.ids, f.parent, f.depth, f.root, f.tin))

    def place(batches):
        from edgeloom.operators.tree_score import _Light

        ids, parent, depth, root, tin = held.value
        g = _Light(ids, parent, depth, root)
        for b in batches:
            l = g.lca(g.at(b.column("u").to_numpy()), g.at(b.column("v").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), b.column("pi"), pa.array(np.where(l >= 0, tin[l], -1))], ["u", "v", "pi", "near"])

    return pool.mapInArrow(place, "u long, v long, pi double, near long")


def sample_support(edges: DataFrame, weights: DataFrame, q: int, offset: float = 0.5, backbone_seed: int = 0, a: float | None = 0.5) -> DataFrame:
    """Exactly q edges: a backbone forest and the mandatory edges, the rest drawn systematically in tree-locality order."""
    forest = stored(random_forest(edges, backbone_seed).select("u", "v"), "draw-forest")
    forced = stored(forest.unionByName(weights.where("mandatory").select("u", "v")).distinct(), "draw-forced")
    n = forced.count()
    if n > q:  # over budget: a hashed part of what is forced
        from edgeloom.operators.select import uniform_sample

        return uniform_sample(forced, q, backbone_seed)
    pool = weights.join(forced, ["u", "v"], "left_anti")
    pool = mixture(pool, a) if a is not None else pool
    pool = stored(_near(pool.select("u", "v", "pi"), forest), "draw-pool")
    p = inclusion(pool, "pi", q - n)
    drawn = systematic(p, "p", q - n, offset, [F.col("near"), F.col("u"), F.col("v")]) if q > n else pool.limit(0)
    return forced.unionByName(drawn.select("u", "v"))


def water_filled(want: np.ndarray, floor: np.ndarray, total: float) -> np.ndarray:
    """``max(floor, c * want)`` with the c that makes the sum ``total``, by bisection."""
    lo, hi = 0.0, max(1.0, total / max(1e-12, want.sum())) * 4
    for _ in range(64):
        c = (lo + hi) / 2
        lo, hi = (lo, c) if np.maximum(floor, c * want).sum() > total else (c, hi)
    return np.maximum(floor, lo * want)


def _rounds(t: pa.Table, left: int, batch: int, whole: bool) -> pa.Table:
    """The edges of the rounds that a pool is enough for: those that need an edge behind its last are left out, unless the pool is ``whole``.

    Costs never fall, so what was behind the last edge of a pool stays behind it. A front of the pool serves many rounds in the same way.
    """
    t = t.sort_by([("u", "ascending"), ("v", "ascending")])
    u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
    ids, first, e = np.unique(np.concatenate([u, v]), return_index=True, return_inverse=True)
    i, j = e[: len(u)], e[len(u) :]
    both = lambda c: np.concatenate([t.column(f"{c}_u").to_numpy(), t.column(f"{c}_v").to_numpy()])[first]
    goal, deg = both("goal"), both("deg").copy()
    kept = np.zeros(len(u), bool)

    def ordered(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = goal - deg
        cost = np.round(1 - 2 * gap[i[at]] + 1 - 2 * gap[j[at]], 9)
        order = np.lexsort((at, cost))
        return at[order], cost[order]

    def before(at: np.ndarray, cost: np.ndarray, end) -> np.ndarray:
        return at if end is None else at[(cost < end[0]) | (cost == end[0]) & (at <= end[1])]

    at, cost = ordered(np.arange(len(u)))
    end = None if whole or not len(at) else (cost[-1], at[-1])
    front = FRONT
    while left:
        at, cost = ordered(np.flatnonzero(~kept))
        rest = before(at, cost, end)
        part = rest[:front]
        if not len(part):
            break
        all_ = len(part) == len(rest)
        stop = end if all_ else (cost[len(part) - 1], part[-1])
        done = 0
        while left:
            now = before(*ordered(part[~kept[part]]), stop)
            need, used, took = min(batch, left), set(), []
            for x, a, b in zip(now.tolist(), i[now].tolist(), j[now].tolist()):
                if a not in used and b not in used:
                    used |= {a, b}
                    took.append(x)
                    if len(took) == need:
                        break
            if len(took) < need and (stop is not None or not took):
                break
            kept[took] = True
            np.add.at(deg, i[took], 1)
            np.add.at(deg, j[took], 1)
            left -= len(took)
            done += 1
        if not done:
            if all_:
                break
            front *= 2
    return pa.table([u[kept], v[kept]], ["u", "v"])


def balanced_completion(union: DataFrame, forest: DataFrame, q: int, batch: int = 128) -> DataFrame:
    """q edges: the forest, then rounds of vertex-disjoint edges that bring degrees nearest to their water-filled targets.

    Each round depends on the last, so one task runs them, but only on the POOL cheapest edges; when a round needs others, the degrees are
    brought up to date and the next pool is taken. The targets are found from one row a node.
    """
    e = stored(union.select("u", "v").join(forest.select("u", "v", F.lit(True).alias("f")), ["u", "v"], "left"), "completion")
    kept, rest = e.where("f").select("u", "v"), e.where("f IS NULL").select("u", "v")
    among = degree(e).withColumnRenamed("deg", "want")
    state = among.join(degree(kept), "node", "left").select("node", "want", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), F.lit(0).alias("g"))

    def targets(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        want, deg = t.column("want").to_numpy(), t.column("deg").to_numpy()
        return pa.table([t.column("node"), pa.array(water_filled(want.astype(float), deg.astype(float), 2.0 * q)), t.column("deg")], ["node", "goal", "deg"])

    state = stored(state.groupBy("g").applyInArrow(targets, "node long, goal double, deg long"), "completion-nodes")
    n, many, size = kept.count(), rest.count(), POOL
    while n < q and many:
        both = with_ends(rest, state, "goal", "deg")
        gap = lambda s: F.col(f"goal_{s}") - F.col(f"deg_{s}")
        both = both.withColumn("cost", F.rint((1 - 2 * gap("u") + 1 - 2 * gap("v")) * F.lit(1e9)) / F.lit(1e9))  # as numpy rounds
        pool = top(both, [F.col("cost"), F.col("u"), F.col("v")], size) if size < many else both
        run = (lambda left, whole: lambda t: _rounds(t, left, batch, whole))(q - n, size >= many)
        new = stored(pool.drop("cost").withColumn("g", F.lit(0)).groupBy("g").applyInArrow(run, "u long, v long"), "completion-new")
        got = new.count()
        if not got:
            size *= 2
            continue
        n, many = n + got, many - got
        kept = kept.unionByName(new)
        rest = stored(rest.join(new, ["u", "v"], "left_anti"), "completion")
        more = degree(new).withColumnRenamed("deg", "more")
        state = stored(state.join(more, "node", "left").select("node", "goal", (F.col("deg") + F.coalesce("more", F.lit(0))).alias("deg")), "completion-nodes")
    return kept


def fast_support(edges: DataFrame, q: int, order, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 0.0) -> DataFrame:
    """q edges: a spanning forest in an order, edges that rejoin trees, then the best tree scores; ties by (u, v)."""
    forest = stored(spanning_forest(edges, order).select("u", "v", "rank"), "fast-forest")
    n = forest.count()
    if n >= q:
        return top(forest, [F.col("rank")], q).select("u", "v")
    s = tree_score(edges.select("u", "v"), forest.select("u", "v"), alpha, beta_e, beta_v)
    rest = top(s.withColumn("s", F.round("score", 9)), [F.col("mandatory").desc(), F.col("s").desc(), F.col("u"), F.col("v")], q - n)
    return forest.select("u", "v").unionByName(rest.select("u", "v"))


def objective(edges: DataFrame, forest: DataFrame, alpha: float = 1.0, beta_e: float = 1.0, beta_v: float = 1.0, p: float = 2.0, q: float = 2.0) -> DataFrame:
    """One row: mean product of dilation and congestions of the omitted edges, and the mean of each; total stretch."""
    t = terms_of(edges, forest, p, q)
    x = F.pow("dil", F.lit(alpha)) * F.pow("ep", F.lit(beta_e)) * F.pow("vp", F.lit(beta_v))
    return t.where("NOT mandatory").agg(F.avg(x).alias("objective"), F.avg("dil").alias("dil"), F.avg("ep").alias("ep"), F.avg("vp").alias("vp"), F.sum("dil").alias("total_stretch"))


def degree_error(edges: DataFrame, support: DataFrame, ratio: float) -> DataFrame:
    """Sum of squared differences between the degrees of a support and a share of the graph's."""
    d = degree(edges).withColumnRenamed("deg", "whole").join(degree(support, nodes(edges)), "node")
    return d.agg(F.sum(F.pow(F.col("deg") - ratio * F.col("whole"), F.lit(2))).alias("error"))


