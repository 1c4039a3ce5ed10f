"""Scores of edges from features, neighbourhoods and degrees; normalisations of adjacency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import adjacency, degree, with_ends

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    """Of two arrays, added up from the left in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def feature_weight(edges: DataFrame, features: DataFrame, kind: str = "cosine") -> DataFrame:
    """``weight`` of each edge: cosine moved to [0, 1], 1 / (1 + distance), the dot product scaled to [0, 1], or 1."""
    if kind == "uniform":
        return edges.withColumn("weight", F.lit(1.0))
    lengths = features.withColumn("len", norm(F.col("x"))) if kind == "cosine" else features
    e = with_ends(edges, lengths, *(("x", "len") if kind == "cosine" else ("x",)))
    if kind == "cosine":
        c = dot(F.col("x_u"), F.col("x_v")) / (F.greatest("len_u", F.lit(1e-12)) * F.greatest("len_v", F.lit(1e-12)))
        w = F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0))
    elif kind == "euclidean":
        w = 1 / (1 + distance(F.col("x_u"), F.col("x_v")))
    else:
        w = dot(F.col("x_u"), F.col("x_v"))
    out = e.withColumn("weight", w).select(*edges.columns, "weight")
    return min_max(out, "weight") if kind == "dot" else out


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Scaled to [0, 1]; all 1 where there is one value only."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, scaled).drop("__lo", "__hi")


def sanitised(c: Column) -> Column:
    """NaN, infinity and null as 0, nothing below 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.greatest(c, F.lit(0.0)))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """``common`` for each edge. Each triangle is found once, from its end that is smallest by (degree, id), as edges are
    turned towards the larger end: no node then has more than sqrt(2 m) to pair, however hot."""
    d = degree(edges)
    e = with_ends(edges.select("u", "v"), d, "deg")
    up = F.struct("deg_u", "u") < F.struct("deg_v", "v")
    turned = e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b"))
    wedge = turned.alias("x").join(turned.select(F.col("a"), F.col("b").alias("c")).alias("y"), "a").where("b < c").select("a", "b", "c")
    closed = wedge.join(edges.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"], "left_semi")
    pair = lambda s, t: F.struct(F.least(s, t).alias("u"), F.greatest(s, t).alias("v"))
    found = closed.select(F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("common"))
    return edges.join(found, ["u", "v"], "left").withColumn("common", F.coalesce("common", F.lit(0)).cast("long"))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """``jaccard`` and ``scan`` (structural similarity of closed neighbourhoods) of each edge."""
    e = with_ends(common_neighbours(edges), degree(edges), "deg")
    e = e.withColumn("jaccard", F.col("common") / (F.col("deg_u") + F.col("deg_v") - F.col("common")))
    return e.withColumn("scan", (F.col("common") + 2) / F.sqrt((F.col("deg_u") + 1.0) * (F.col("deg_v") + 1.0)))


def local_rank_score(edges: DataFrame, score: str, out: str) -> DataFrame:
    """The larger of ``1 - ln(rank) / ln(degree)`` over both ends, ranking each end's edges by a column of the far end or the edge."""
    a = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col(f"{score}_v").alias("s")).unionAll(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), F.col(f"{score}_u").alias("s")))
    r = F.rank().over(Window.partitionBy("src").orderBy(F.col("s").desc()))
    n = F.count("*").over(Window.partitionBy("src"))
    a = a.withColumn("r", r).withColumn("n", n)
    a = a.withColumn("z", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(1 - F.log(F.col("r").cast("double")) / F.log(F.col("n").cast("double"))))
    best = a.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max("z").alias(out))
    return edges.join(best, ["u", "v"])


def local_degree(edges: DataFrame) -> DataFrame:
    return local_rank_score(with_ends(edges, degree(edges), "deg"), "deg", "local_degree")


def local_similarity(edges: DataFrame) -> DataFrame:
    e = neighbourhood(edges).withColumn("j_u", F.round("jaccard", 9)).withColumn("j_v", F.round("jaccard", 9))
    return local_rank_score(e, "j", "lsim")


def degree_probability(edges: DataFrame) -> DataFrame:
    """``p`` of each edge, in proportion to the sum of the inverse degrees of its ends."""
    e = with_ends(edges, degree(edges), "deg").withColumn("s", 1 / F.col("deg_u") + 1 / F.col("deg_v"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("s").alias("__t")))).withColumn("p", F.col("s") / F.col("__t")).drop("s", "__t")


def support_score(dil: Column, ep: Column, vp: Column, d: Column, e: Column, v: Column, alpha: float, beta_e: float, beta_v: float) -> Column:
    """Product of dilation and path congestions, each relative to its largest, with their exponents."""
    part = lambda x, top, power: F.pow((x + EPS) / (top + EPS), F.lit(float(power)))
    return part(dil, d, alpha) * part(ep, e, beta_e) * part(vp, v, beta_v)


def log_score(dil: Column, e_max: Column, v_max: Column, beta_e: float, beta_v: float) -> Column:
    """Dilation times one plus the logarithms of the largest congestions on the path."""
    return dil * (1 + beta_e * F.log1p(e_max) + beta_v * F.log1p(v_max))


def bucket(score: Column, lo: Column, hi: Column, n: int = 256, largest_first: bool = False) -> Column:
    """Place of a score among n equal buckets of its range."""
    b = F.when(hi > lo, F.floor((score - lo) * (n - 1) / (hi - lo))).otherwise(F.lit(0))
    b = F.least(F.greatest(b, F.lit(0)), F.lit(n - 1))
    return (n - 1 - b if largest_first else b).cast("int")


def softmax(a: Column) -> Column:
    # a pair of (e, total) keeps both from being computed again for each element
    e = F.transform(F.array(F.array_max(a)), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    parts = F.transform(e, lambda v: F.struct(v.alias("e"), F.aggregate(v, F.lit(0.0), lambda s, y: s + y).alias("total")))
    return F.flatten(F.transform(parts, lambda p: F.transform(p["e"], lambda x: x / p["total"])))


def argmax(a: Column) -> Column:
    """Place of the largest, the first of equals, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def gated(a: Column, k: int) -> Column:
    """Softmax over the k largest, 0 elsewhere; of equals the first."""
    order = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    keep = F.transform(F.slice(order, 1, k), lambda s: s["i"])
    low = F.transform(a, lambda x, i: F.when(F.array_contains(keep, i), F.exp(x - F.array_max(a))).otherwise(F.lit(0.0)))
    return F.transform(low, lambda x: x / F.aggregate(low, F.lit(0.0), lambda s, y: s + y))


def gcn_chebyshev(edges: DataFrame, k: int) -> list[DataFrame]:
    """``(i, j, w)`` of the Chebyshev polynomials T_0 to T_k of the normalised Laplacian less the identity (that is -D^-1/2 A D^-1/2); zeros are left out."""
    from edgeloom.session import stored

    d = degree(edges)
    a = adjacency(edges.select("u", "v")).join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dt"), "dst")
    x = stored(a.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-1 / F.sqrt(F.col("ds") * F.col("dt"))).alias("w")), "cheb")
    out = [d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("w")), x]
    while len(out) <= k:
        both = x.select("i", F.col("j").alias("m"), (2 * F.col("w")).alias("a")).join(out[-1].select(F.col("i").alias("m"), "j", F.col("w").alias("b")), "m")
        t = both.select("i", "j", (F.col("a") * F.col("b")).alias("w")).unionAll(out[-2].select("i", "j", -F.col("w")))
        out.append(stored(t.groupBy("i", "j").agg(F.sum("w").alias("w")).where("w <> 0"), "cheb"))
    return out[: k + 1]


def row_normalised(x: Column) -> Column:
    """An array divided by its sum; zeros where that is 0."""
    s = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return F.transform(x, lambda e: F.when(s != 0, e / s).otherwise(F.lit(0.0)))


def gcn_norm(adj: DataFrame, among: DataFrame) -> DataFrame:
    """Symmetric normalisation with loops of weight 1; degrees are at least 1."""
    w = adj.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w"))
    full = w.unionAll(among.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))
    d = full.groupBy(F.col("dst").alias("node")).agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("d"))
    out = full.join(d.withColumnRenamed("node", "src").withColumnRenamed("d", "ds"), "src").join(d.withColumnRenamed("node", "dst").withColumnRenamed("d", "dt"), "dst")
    return out.select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dt"))).alias("w"))


def normalisations(edges: DataFrame) -> DataFrame:
    """``(kind, i, j, w)``: the usual operators made of A, its degrees and the identity I.

    With S = D^-1/2 A D^-1/2, P = D^-1 A and ~ for A + I: ``norm_lap`` I - S, ``lap`` D - A, ``gcn`` I + S, ``aug_norm`` S~,
    ``bingge`` S~ + I, ``norm_adj`` S, ``rw_lap`` I - P, ``aug_rw`` P~, ``rw`` P, ``none`` A, ``identity`` A + I.
    """
    d = degree(edges)
    a = adjacency(edges.select("u", "v"))
    off = a.join(d.withColumnRenamed("node", "src").withColumnRenamed("deg", "di"), "src").join(d.withColumnRenamed("node", "dst").withColumnRenamed("deg", "dj"), "dst")
    cell = off.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("di").cast("double").alias("di"), F.col("dj").cast("double").alias("dj"), F.lit(1.0).alias("a"), F.lit(0.0).alias("e"))
    cell = cell.unionAll(d.select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("deg").cast("double").alias("di"), F.col("deg").cast("double").alias("dj"), F.lit(0.0).alias("a"), F.lit(1.0).alias("e")))
    a_, e, di, dj = F.col("a"), F.col("e"), F.col("di"), F.col("dj")
    s, p = a_ / F.sqrt(di * dj), a_ / di
    st, pt = (a_ + e) / F.sqrt((di + 1) * (dj + 1)), (a_ + e) / (di + 1)
    kinds = {"norm_lap": e - s, "lap": e * di - a_, "gcn": e + s, "aug_norm": st, "bingge": st + e, "norm_adj": s, "rw_lap": e - p, "aug_rw": pt, "rw": p, "none": a_, "identity": a_ + e}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("w")) for k, v in kinds.items()])).alias("r")
    return cell.select("i", "j", rows).select("r.kind", "i", "j", "r.w").where("w <> 0")


def _added(how: str):
    """Adds up messages ``(node, w, x)`` that come sorted by node, batch by batch; a node cut by a batch is carried on."""

    def run(batches):
        node, total, weight = None, None, 0.0  # the last node, which may go on in the next batch

        def rows(ids, sums, weights):
            sums = sums if how == "sum" else sums / weights[:, None]
            flat = pa.array(sums.ravel())
            ends = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, flat)], ["node", "x"])

        for t in batches:
            if not len(t):
                continue
            ids, w = t.column("node").to_numpy(), t.column("w").to_numpy()
            x = t.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) * w[:, None]
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            heads, sums, weights = ids[first], np.add.reduceat(x, first, axis=0), np.add.reduceat(w, first)
            if node is not None:
                if heads[0] == node:
                    sums[0] += total
                    weights[0] += weight
                else:
                    yield rows(np.array([node]), total[None], np.array([weight]))
            node, total, weight = heads[-1], sums[-1].copy(), weights[-1]
            if len(heads) > 1:
                yield rows(heads[:-1], sums[:-1], weights[:-1])
        if node is not None:
            yield rows(np.array([node]), total[None], np.array([weight]))

    return run


def spread(adj: DataFrame, features: DataFrame, how: str = "sum") -> DataFrame:
    """``(node, x)``: features of in-neighbours, weighted and added, or their weighted mean.

    Features are arrays of one length without nulls. A message is shuffled whole and once, sorted by its node, and added to
    the sum that is being built, so no task holds more than a batch, however many neighbours a node has.
    """
    m = adj.join(features.select(F.col("node").alias("src"), "x"), "src")
    m = m.select(F.col("dst").alias("node"), F.col("w").cast("double").alias("w"), F.col("x").cast("array<double>").alias("x"))
    node = adj.schema["dst"].dataType.simpleString()
    return m.repartition("node").sortWithinPartitions("node").mapInArrow(_added(how), f"node {node}, x array<double>")
