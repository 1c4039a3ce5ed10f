"""Queries of scores, normalisations, message passing, selection and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgeloom.functions import scoring as S
from edgeloom.operators import edges as E
from edgeloom.operators import select as C
from edgeloom.plans.edge_queries import R, md5, u01
from edgeloom.plans.registry import query
from edgeloom.session import stored
from edgeloom.sources import views as V
from edgeloom.sources.views import sql

XY = "kg JOIN embeddings a ON kg.u = a.vec_id JOIN embeddings b ON kg.v = b.vec_id"
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
DEG = "dg AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM {g} UNION ALL SELECT v FROM {g}) GROUP BY 1)"
ADJ = "adj AS (SELECT u AS src, v AS dst, w FROM {g} UNION ALL SELECT v, u, w FROM {g})"
NBR = f"{DEG.format(g='ug')}, {ADJ.format(g='ug')}, cn AS (SELECT e.u, e.v, count(*) AS c FROM ug e JOIN adj a ON a.src = e.u JOIN adj b ON b.src = e.v AND b.dst = a.dst GROUP BY 1, 2), nb AS (SELECT e.u, e.v, e.w, coalesce(c, 0) AS c, du.deg AS du, dv.deg AS dv FROM ug e LEFT JOIN cn USING (u, v) JOIN dg du ON du.node = e.u JOIN dg dv ON dv.node = e.v)"


@query("nearest_neighbours", sql("SELECT src, rank, dst, round(cos, 6) AS cos FROM nn", "nn"))
def _(spark, sf):
    return V.nearest(V.vectors(spark, sf)).withColumn("cos", R("cos", 6)).select("src", F.col("rank").cast("long").alias("rank"), "dst", "cos")


@query("dilated_neighbours", sql("SELECT src, rank, dst FROM nn WHERE (rank - 1) % 2 = 0", "nn"))
def _(spark, sf):
    return V.nearest(V.vectors(spark, sf), 4, 2).select("src", F.col("rank").cast("long").alias("rank"), "dst")


@query("cosine_weight", sql(f"SELECT u, v, round(least(greatest(({COS} + 1) / 2, 0), 1), 6) AS weight FROM {XY}", "kg"))
def _(spark, sf):
    return S.feature_weight(V.knn_graph(spark, sf), V.vectors(spark, sf), "cosine").select("u", "v", R("weight", 6).alias("weight"))


@query("euclid_weight", sql(f"SELECT u, v, round(1 / (1 + list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS weight FROM {XY}", "kg"))
def _(spark, sf):
    return S.feature_weight(V.knn_graph(spark, sf), V.vectors(spark, sf), "euclidean").select("u", "v", R("weight", 6).alias("weight"))


@query("dot_weight", sql(f"WITH d AS (SELECT u, v, {DOT} AS d FROM {XY}) SELECT u, v, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS weight FROM d", "kg"))
def _(spark, sf):
    return S.feature_weight(V.knn_graph(spark, sf), V.vectors(spark, sf), "dot").select("u", "v", R("weight", 6).alias("weight"))


@query("uniform_weight", sql("SELECT u, v, 1.0::DOUBLE AS weight FROM ps", "ps"))
def _(spark, sf):
    return S.feature_weight(V.part_supplier(spark, sf), None, "uniform").select("u", "v", "weight")


@query("jaccard", sql(f"WITH {NBR} SELECT u, v, c AS common, round(c / (du + dv - c), 6) AS jaccard FROM nb", "ug"))
def _(spark, sf):
    return S.neighbourhood(stored(V.user_graph(spark, sf).select("u", "v"))).select("u", "v", "common", R("jaccard", 6).alias("jaccard"))


@query("scan", sql(f"WITH {NBR} SELECT u, v, round((c + 2) / sqrt((du + 1.0) * (dv + 1.0)), 6) AS scan FROM nb", "ug"))
def _(spark, sf):
    return S.neighbourhood(V.user_graph(spark, sf)).select("u", "v", R("scan", 6).alias("scan"))


def LOCAL(src, own, far):
    return f"SELECT u, v, round(max(z), 6) AS {own} FROM (SELECT least(src, dst) AS u, greatest(src, dst) AS v, CASE WHEN n <= 1 THEN 1 ELSE 1 - ln(r) / ln(n) END AS z FROM (SELECT src, dst, rank() OVER (PARTITION BY src ORDER BY s DESC) AS r, count(*) OVER (PARTITION BY src) AS n FROM ({far}) x) y) z GROUP BY 1, 2"


LSIM = f"{NBR}, j AS (SELECT u, v, round(c / (du + dv - c), 9) AS s FROM nb)"
LSIM_Q = LOCAL("u", "lsim", "SELECT u AS src, v AS dst, s FROM j UNION ALL SELECT v, u, s FROM j")
LDEG_Q = LOCAL("u", "local_degree", "SELECT src, dst, deg AS s FROM adj JOIN dg ON dg.node = adj.dst")


@query("local_similarity", sql(f"WITH {LSIM} {LSIM_Q}", "ug"))
def _(spark, sf):
    return S.local_similarity(V.user_graph(spark, sf)).select("u", "v", R("lsim", 6).alias("lsim"))


@query("local_degree", sql(f"WITH {DEG.format(g='ps')}, {ADJ.format(g='ps')} {LDEG_Q}", "ps"))
def _(spark, sf):
    return S.local_degree(V.part_supplier(spark, sf)).select("u", "v", R("local_degree", 6).alias("local_degree"))


DSPAR = f"{DEG.format(g='ps')}, s AS (SELECT u, v, w, 1 / a.deg + 1 / b.deg AS s FROM ps JOIN dg a ON a.node = u JOIN dg b ON b.node = v), p AS (SELECT u, v, w, s / sum(s) OVER () AS p FROM s)"


@query("degree_probability", sql(f"WITH {DSPAR} SELECT u, v, round(p, 12) AS p FROM p", "ps"))
def _(spark, sf):
    return S.degree_probability(V.part_supplier(spark, sf)).select("u", "v", R("p", 12).alias("p"))


@query("candidate_weight", sql("WITH h AS (SELECT u, v FROM ug WHERE w >= 2), d AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM h UNION ALL SELECT v FROM h) GROUP BY 1) SELECT e.u, e.v, round(1 / greatest(coalesce(a.deg, 0), 1) + 1 / greatest(coalesce(b.deg, 0), 1), 6) AS weight FROM ug e LEFT JOIN d a ON a.node = e.u LEFT JOIN d b ON b.node = e.v WHERE e.w < 2", "ug"))
def _(spark, sf):
    e = V.user_graph(spark, sf)
    d = E.degree(e.where("w >= 2"), E.nodes(e))
    out = E.with_ends(e.where("w < 2"), d, "deg")
    inv = lambda c: 1 / F.greatest(F.col(c), F.lit(1))
    return out.select("u", "v", R(inv("deg_u") + inv("deg_v"), 6).alias("weight"))


@query("leverage", sql("SELECT u, v, round(greatest(CASE WHEN u % 17 = 0 THEN 0.0 ELSE w * (1.0 / (w + 3)) END, 0), 6)::DOUBLE AS leverage FROM ps", "ps"))
def _(spark, sf):
    r = F.when(F.col("u") % 17 == 0, F.lit(float("nan"))).otherwise(1.0 / (F.col("w") + 3))
    return V.part_supplier(spark, sf).select("u", "v", R(S.sanitised(F.col("w") * r), 6).alias("leverage"))


@query("log_score", sql("SELECT u, v, round(w * (1 + 0.5 * ln(1 + u % 13) + 0.25 * ln(1 + v % 7)), 6) AS score FROM ps", "ps"))
def _(spark, sf):
    return V.part_supplier(spark, sf).select("u", "v", R(S.log_score(F.col("w"), F.col("u") % 13, F.col("v") % 7, 0.5, 0.25), 6).alias("score"))


@query("score_buckets", sql("SELECT b AS bucket, count(*) AS n FROM (SELECT 255 - least(greatest(floor((w - min(w) OVER ()) * 255 / (max(w) OVER () - min(w) OVER ())), 0), 255)::INT AS b FROM ps) GROUP BY 1", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    ends = F.broadcast(e.agg(F.min("w").alias("lo"), F.max("w").alias("hi")))
    return e.crossJoin(ends).groupBy(S.bucket(F.col("w"), F.col("lo"), F.col("hi"), 256, True).alias("bucket")).agg(F.count("*").alias("n"))


@query("softmax_argmax", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: exp(x - m))) , 6) AS total, round(1 / list_sum(list_transform(e, lambda x: exp(x - m))), 6) AS top, (list_position(e, m) - 1)::INT AS arg FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(embedding::DOUBLE[]) AS m FROM embeddings)")
def _(spark, sf):
    x = F.col("x")
    t = F.aggregate(F.transform(x, lambda e: F.exp(e - F.array_max(x))), F.lit(0.0), lambda a, b: a + b)
    return V.vectors(spark, sf).select(F.col("node").alias("vec_id"), R(t, 6).alias("total"), R(F.array_max(S.softmax(x)), 6).alias("top"), S.argmax(x).alias("arg"))


@query("row_normalised", "SELECT vec_id, pos, round(e[pos + 1] / s, 6) AS x FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * x) AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings), (SELECT unnest(range(0, 64))::INT AS pos)")
def _(spark, sf):
    x = S.row_normalised(F.transform("x", lambda e: e * e))
    return V.vectors(spark, sf).select(F.col("node").alias("vec_id"), F.posexplode(x).alias("pos", "x")).withColumn("x", R("x", 6))


@query("gcn_norm", sql(f"WITH {ADJ.format(g='ug')}, n AS (SELECT DISTINCT src AS node FROM adj), f AS (SELECT src, dst, w FROM adj UNION ALL SELECT node, node, 1 FROM n), d AS (SELECT dst AS node, greatest(sum(w), 1) AS d FROM f GROUP BY 1) SELECT src, dst, round(w / sqrt(a.d * b.d), 6) AS w FROM f JOIN d a ON a.node = src JOIN d b ON b.node = dst", "ug"))
def _(spark, sf):
    e = stored(V.user_graph(spark, sf))
    return S.gcn_norm(E.adjacency(e), E.nodes(e)).withColumn("w", R("w", 6))


KINDS = {"norm_lap": "e - a / sqrt(di * dj)", "lap": "e * di - a", "gcn": "e + a / sqrt(di * dj)", "aug_norm": "(a + e) / sqrt((di + 1) * (dj + 1))", "bingge": "(a + e) / sqrt((di + 1) * (dj + 1)) + e", "norm_adj": "a / sqrt(di * dj)", "rw_lap": "e - a / di", "aug_rw": "(a + e) / (di + 1)", "rw": "a / di", "none": "a", "identity": "a + e"}


@query(
    "normalisations",
    sql(
        f"WITH {DEG.format(g='kg')}, {ADJ.format(g='kg')}, c AS (SELECT src AS i, dst AS j, x.deg::DOUBLE AS di, y.deg::DOUBLE AS dj, 1.0::DOUBLE AS a, 0.0::DOUBLE AS e FROM adj JOIN dg x ON x.node = src JOIN dg y ON y.node = dst UNION ALL SELECT node, node, deg, deg, 0, 1 FROM dg) SELECT kind, i, j, round(w, 6) + 0.0::DOUBLE AS w FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS kind, i, j, {x} AS w FROM c" for k, x in KINDS.items())
        + ") WHERE w <> 0",
        "kg",
    ),
)
def _(spark, sf):
    return S.normalisations(V.knn_graph(spark, sf)).withColumn("w", R("w", 6))


LONG = "x AS (SELECT vec_id AS node, unnest(range(0, len(embedding)))::INT AS pos, unnest(embedding::DOUBLE[]) AS e FROM embeddings)"


def long_rows(df):
    return df.select("node", F.posexplode("x").alias("pos", "e")).withColumn("e", R("e", 6))


@query("neighbour_mean", sql(f"WITH {ADJ.format(g='kg')}, {LONG} SELECT dst AS node, pos, round(sum(w * e) / sum(w), 6) + 0.0::DOUBLE AS e FROM adj JOIN x ON x.node = src GROUP BY 1, 2", "kg"))
def _(spark, sf):
    return long_rows(S.spread(E.adjacency(V.knn_graph(spark, sf)), V.vectors(spark, sf), "mean"))


@query(
    "sgc_two_steps",
    sql(f"WITH {ADJ.format(g='kg')}, n AS (SELECT DISTINCT src AS node FROM adj), f AS (SELECT src, dst, w FROM adj UNION ALL SELECT node, node, 1 FROM n), d AS (SELECT dst AS node, greatest(sum(w), 1) AS d FROM f GROUP BY 1), g AS (SELECT src, dst, w / sqrt(a.d * b.d) AS w FROM f JOIN d a ON a.node = src JOIN d b ON b.node = dst), {LONG}, h AS (SELECT dst AS node, pos, sum(w * e) AS e FROM g JOIN x ON x.node = src GROUP BY 1, 2) SELECT dst AS node, pos, round(sum(w * e), 6) + 0.0::DOUBLE AS e FROM g JOIN h ON h.node = src GROUP BY 1, 2", "kg"),
)
def _(spark, sf):
    e = V.knn_graph(spark, sf)
    a = S.gcn_norm(E.adjacency(e), E.nodes(e))
    return long_rows(S.spread(a, S.spread(a, V.vectors(spark, sf))))


@query("chebyshev_t2", sql(f"WITH {DEG.format(g='kg')}, {ADJ.format(g='kg')}, l AS (SELECT src AS i, dst AS j, -1 / sqrt(a.deg * b.deg) AS w FROM adj JOIN dg a ON a.node = src JOIN dg b ON b.node = dst), t AS (SELECT l.i, m.j, 2 * sum(l.w * m.w) AS w FROM l JOIN l m ON l.j = m.i GROUP BY 1, 2 UNION ALL SELECT node, node, -1 FROM dg) SELECT i, j, round(sum(w), 6) + 0.0::DOUBLE AS w FROM t GROUP BY 1, 2 HAVING abs(sum(w)) > 1e-9", "kg"))
def _(spark, sf):
    e = V.knn_graph(spark, sf)
    lap = S.normalisations(e).where("kind = 'norm_adj'").select("i", "j", (-F.col("w")).alias("w"))
    two = lap.alias("a").join(lap.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("w").alias("x")), "j").groupBy("i", F.col("k").alias("j")).agg((2 * F.sum(F.col("w") * F.col("x"))).alias("w"))
    eye = E.nodes(e).select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(-1.0).alias("w"))
    return two.unionByName(eye).groupBy("i", "j").agg(F.sum("w").alias("w")).where("abs(w) > 1e-9").withColumn("w", R("w", 6))


@query("edge_features_to_nodes", sql("SELECT l_partkey AS node, pos, sum(v) AS total, round(avg(v), 6) AS mean, max(v) AS most FROM (SELECT l_partkey, unnest([0, 1]) AS pos, unnest([l_quantity, l_linenumber::DOUBLE]) AS v FROM lineitem) GROUP BY 1, 2"))
def _(spark, sf):
    t = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.posexplode(F.array("l_quantity", F.col("l_linenumber").cast("double"))).alias("pos", "v"))
    return t.groupBy("node", "pos").agg(F.sum("v").alias("total"), R(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


@query("row_softmax", sql(f"WITH {ADJ.format(g='ug')} SELECT src, dst, round(exp(w - m) / sum(exp(w - m)) OVER (PARTITION BY src), 6) AS p FROM (SELECT *, max(w) OVER (PARTITION BY src) AS m FROM adj)", "ug"))
def _(spark, sf):
    w = Window.partitionBy("src")
    a = E.adjacency(V.user_graph(spark, sf)).withColumn("x", F.exp(F.col("w") - F.max("w").over(w)))
    return a.select("src", "dst", R(F.col("x") / F.sum("x").over(w), 6).alias("p"))


@query("power_mean", sql(f"WITH {ADJ.format(g='kg')}, {LONG} SELECT dst AS node, pos, round(power(avg(power(least(greatest(e, 1e-7), 10), 3)), 1 / 3.0::DOUBLE), 6) AS e FROM adj JOIN x ON x.node = src WHERE pos < 4 GROUP BY 1, 2", "kg"))
def _(spark, sf):
    m = E.adjacency(V.knn_graph(spark, sf)).join(V.vectors(spark, sf).select(F.col("node").alias("src"), F.posexplode(F.slice("x", 1, 4)).alias("pos", "e")), "src")
    return m.groupBy(F.col("dst").alias("node"), "pos").agg(R(F.pow(F.avg(F.pow(F.least(F.greatest("e", F.lit(1e-7)), F.lit(10.0)), F.lit(3))), F.lit(1 / 3.0)), 6).alias("e"))


@query("gated_experts", "WITH l AS (SELECT vec_id, [embedding[1], embedding[2], embedding[3], embedding[4], embedding[5]]::DOUBLE[] AS a FROM embeddings), t AS (SELECT vec_id, a, list_sort(a, 'DESC')[2] AS cut, list_max(a) AS m FROM l), g AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN x >= cut THEN exp(x - m) ELSE 0.0 END) AS e FROM t) SELECT vec_id, pos, round(e[pos + 1] / list_sum(e), 6) AS gate FROM g, (SELECT unnest(range(0, 5))::INT AS pos)")
def _(spark, sf):
    return V.vectors(spark, sf).select(F.col("node").alias("vec_id"), F.posexplode(S.gated(F.slice("x", 1, 5), 2)).alias("pos", "gate")).withColumn("gate", R("gate", 6))


@query("soft_mask", sql("WITH s AS (SELECT u, v, w, avg(w) OVER () AS m, stddev_pop(w) OVER () AS d FROM ug), z AS (SELECT u, v, (w - m) * (0.01 / greatest(d, 1e-3)) + 1 AS s, (u % 5) * 0.1 AS t FROM s) SELECT u, v, 1 / (1 + exp(-(s - 0.02 * (t * t * t + 20 * t)) / 0.1)) > 0.5 AS kept FROM z", "ug"))
def _(spark, sf):
    e = V.user_graph(spark, sf)
    m = F.broadcast(e.agg(F.avg("w").alias("m"), F.stddev_pop("w").alias("d")))
    t = (F.col("u") % 5) * 0.1
    s = (F.col("w") - F.col("m")) * (0.01 / F.greatest("d", F.lit(1e-3))) + 1
    return e.crossJoin(m).select("u", "v", (1 / (1 + F.exp(-(s - 0.02 * (t * t * t + 20 * t)) / 0.1)) > 0.5).alias("kept"))


# Selection


@query("gspar_topk", sql(f"WITH {NBR} SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY round(c / (du + dv - c), 9) DESC, u, v) AS r, count(*) OVER () AS m FROM nb) WHERE r <= round_even(0.3 * m, 0)", "ug"))
def _(spark, sf):
    e = stored(V.user_graph(spark, sf).select("u", "v"))
    return C.top_k(S.neighbourhood(e), R("jaccard", 9), E.budget(e.count(), 0.3, "round")).select("u", "v")


@query("lspar_per_node", sql(f"WITH {NBR}, a AS (SELECT u AS src, v AS dst, round(c / (du + dv - c), 9) AS s, du AS d FROM nb UNION ALL SELECT v, u, round(c / (du + dv - c), 9), dv FROM nb) SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM a) WHERE r <= greatest(1, floor(power(d, 0.6)))", "ug"))
def _(spark, sf):
    e = S.neighbourhood(V.user_graph(spark, sf)).withColumn("s", R("jaccard", 9))
    a = e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "s", F.col("deg_u").alias("d")).unionAll(e.select("v", "u", "s", "deg_v"))
    kept = C.per_node(a, F.col("s"), F.greatest(F.lit(1), F.floor(F.pow("d", F.lit(0.6)))))
    return kept.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


@query("lsim_topk", sql(f"WITH {LSIM}, l AS ({LSIM_Q}) SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY lsim DESC, u, v) AS r, count(*) OVER () AS m FROM l) WHERE r <= round_even(0.3 * m, 0)", "ug"))
def _(spark, sf):
    e = stored(V.user_graph(spark, sf).select("u", "v"))
    return C.top_k(S.local_similarity(e), R("lsim", 6), E.budget(e.count(), 0.3, "round")).select("u", "v")


@query("scan_topk", sql(f"WITH {NBR} SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY round((c + 2) / sqrt((du + 1.0) * (dv + 1.0)), 9) DESC, u, v) AS r, count(*) OVER () AS m FROM nb) WHERE r <= round_even(0.3 * m, 0)", "ug"))
def _(spark, sf):
    e = stored(V.user_graph(spark, sf).select("u", "v"))
    return C.top_k(S.neighbourhood(e), R("scan", 9), E.budget(e.count(), 0.3, "round")).select("u", "v")


@query("local_degree_topk", sql(f"WITH {DEG.format(g='ps')}, {ADJ.format(g='ps')}, l AS ({LDEG_Q}) SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY local_degree DESC, u, v) AS r, count(*) OVER () AS m FROM l) WHERE r <= round_even(0.3 * m, 0)", "ps"))
def _(spark, sf):
    e = stored(V.part_supplier(spark, sf).select("u", "v"))
    return C.top_k(S.local_degree(e), R("local_degree", 6), E.budget(e.count(), 0.3, "round")).select("u", "v")


@query("random_topk", sql(f"SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY {md5(3, 'u', 'v')}, u, v) AS r, count(*) OVER () AS m FROM ps) WHERE r <= round_even(0.3 * m, 0)", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return C.uniform_sample(e, E.budget(e.count(), 0.3, "round"), 3).select("u", "v")


@query("mandatory_first", sql("SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY (u % 10 = 0)::INT DESC, w DESC, u, v) AS r FROM ps) WHERE r <= 500", "ps"))
def _(spark, sf):
    return C.mandatory_first(V.part_supplier(spark, sf).withColumn("mandatory", F.col("u") % 10 == 0), F.col("w"), 500).select("u", "v")


@query("threshold_with_ties", sql(f"WITH {ADJ.format(g='ug')} SELECT src, dst FROM (SELECT src, dst, rank() OVER (PARTITION BY src ORDER BY w DESC) AS r FROM adj) WHERE r <= 3", "ug"))
def _(spark, sf):
    return C.per_node(E.adjacency(V.user_graph(spark, sf)), F.col("w"), F.lit(3), ties=True).select("src", "dst")


@query("one_each_then_global", sql(f"WITH {ADJ.format(g='ug')}, r AS (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM adj), b AS (SELECT src, dst FROM r WHERE r = 1), x AS (SELECT src, dst, row_number() OVER (ORDER BY w DESC, src, dst) AS k FROM r WHERE r > 1) SELECT src, dst FROM b UNION ALL SELECT src, dst FROM x WHERE k <= 400 - (SELECT count(*) FROM b)", "ug"))
def _(spark, sf):
    return C.one_each(E.adjacency(V.user_graph(spark, sf)), F.col("w"), 400).select("src", "dst")


@query("pair_mean_topk", sql("WITH p AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, avg((src * 13 + dst * 7) % 101) AS s FROM (SELECT DISTINCT src, dst FROM tr) WHERE src <> dst GROUP BY 1, 2), k AS (SELECT u, v, s, row_number() OVER (ORDER BY s DESC, u, v) AS r FROM p) SELECT u AS src, v AS dst FROM k WHERE r <= 300 UNION ALL SELECT v, u FROM k WHERE r <= 300", "tr"))
def _(spark, sf):
    t = V.transitions(spark, sf).distinct().where("src <> dst").withColumn("s", (F.col("src") * 13 + F.col("dst") * 7) % 101)
    p = t.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.avg("s").alias("s"))
    return E.adjacency(C.top_k(p, F.col("s"), 300).select("u", "v"))


@query("ticket", sql("WITH e AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS i, count(*) OVER () AS m FROM ug), t AS (SELECT (floor(k * m / least(700, m))::BIGINT + (5 * 2654435761) % m) % m AS i FROM (SELECT DISTINCT m FROM e), range(700) AS r(k) WHERE k < m) SELECT u, v FROM e JOIN t USING (i)", "ug"))
def _(spark, sf):
    return C.ticket(V.user_graph(spark, sf).select("u", "v"), 700, 5).select("u", "v")


@query("bernoulli", sql(f"SELECT u, v FROM ps WHERE {u01(4, 'u', 'v')} < 0.2", "ps"))
def _(spark, sf):
    return C.bernoulli(V.part_supplier(spark, sf), 0.2, 4).select("u", "v")


@query("cut_probability", sql("SELECT round(least(1, 16 * 3 * ln(greatest(n, 2)) / (100 * 10)), 6) AS p FROM (SELECT count(*) AS n FROM (SELECT u FROM ug UNION SELECT v FROM ug))", "ug"))
def _(spark, sf):
    n = E.nodes(V.user_graph(spark, sf)).agg(F.count("*").alias("n"))
    return n.select(R(F.least(F.lit(1.0), 16 * 3 * F.log(F.greatest("n", F.lit(2)).cast("double")) / (100 * 10)), 6).alias("p"))


RACE = f"{DSPAR}, a AS (SELECT u, v, w, p, round(-ln(1 - {u01(6, 'u', 'v')}) / p, 9) AS t FROM p), k AS (SELECT *, row_number() OVER (ORDER BY t, u, v) AS r FROM a)"


@query("dspar_race", sql(f"WITH {RACE} SELECT u, v FROM k WHERE r <= 2000", "ps"))
def _(spark, sf):
    return C.race(S.degree_probability(stored(V.part_supplier(spark, sf).select("u", "v"))), F.col("p"), 2000, 6).select("u", "v")


@query("dspar_reweighted", sql(f"WITH {RACE} SELECT u, v, round(1 / least(1, 2000 * p), 6) AS weight FROM k WHERE r <= 2000", "ps"))
def _(spark, sf):
    kept = C.race(S.degree_probability(V.part_supplier(spark, sf)), F.col("p"), 2000, 6)
    return kept.select("u", "v", R(1 / F.least(F.lit(1.0), 2000 * F.col("p")), 6).alias("weight"))


@query("k_random_neighbours", sql(f"WITH {ADJ.format(g='ps')} SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {md5(8, 'src', 'dst')}, dst) AS r FROM adj) WHERE r <= 5", "ps"))
def _(spark, sf):
    return C.random_neighbours(E.adjacency(V.part_supplier(spark, sf)), 5, 8)


PIPS = "r AS (SELECT u, v, w, row_number() OVER (ORDER BY w DESC, u, v) AS i, sum(w) OVER (ORDER BY w DESC, u, v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM ug), k AS (SELECT count(*) AS n, coalesce(sum(w), 0) AS s FROM r WHERE w * (1500 - i + 1) >= t - c + w), p AS (SELECT u, v, w, CASE WHEN i <= n THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, w * (1500 - n) / (t - s)) END AS p FROM r, k)"


@query("pips_probabilities", sql(f"WITH {PIPS} SELECT u, v, round(p, 9) AS p FROM p", "ug"))
def _(spark, sf):
    return C.inclusion(V.user_graph(spark, sf), "w", 1500).select("u", "v", R("p", 9).alias("p"))


@query("systematic_draw", sql(f"WITH {PIPS}, c AS (SELECT u, v, p, sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS c FROM p), h AS (SELECT u, v, p, greatest(-1, least(floor(round(c - 0.37, 9)), 1499)) > greatest(-1, least(floor(round(c - p - 0.37, 9)), 1499)) AS hit FROM c), o AS (SELECT u, v, hit, row_number() OVER (PARTITION BY hit ORDER BY p DESC, u, v) AS r FROM h) SELECT u, v FROM o WHERE hit OR r <= 1500 - (SELECT count(*) FROM h WHERE hit)", "ug"))
def _(spark, sf):
    p = C.inclusion(stored(V.user_graph(spark, sf)), "w", 1500)
    return C.systematic(p, "p", 1500, 0.37, [F.col("u"), F.col("v")]).select("u", "v")


@query("draws_with_replacement", sql(f"WITH {DSPAR}, c AS (SELECT u, v, p, sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS c FROM p), d AS (SELECT {u01(9, 'k')} AS t FROM range(3000) AS r(k)) SELECT sum(n)::BIGINT AS draws, count(*) >= 2800 AS spread_out FROM (SELECT c.u, c.v, count(*) AS n FROM d ASOF JOIN c ON d.t < c.c GROUP BY 1, 2)", "ps"))
def _(spark, sf):
    p = S.degree_probability(V.part_supplier(spark, sf)).select("u", "v", "p")
    d = C.with_replacement(p, "p", 3000, [F.col("u"), F.col("v")], 9)
    return d.agg(F.sum("n").alias("draws"), (F.count("*") >= 2800).alias("spread_out"))


@query("random_walks")
def _(spark, sf):
    e = V.user_graph(spark, sf)
    return C.walks(E.adjacency(e.select("u", "v")), E.nodes(e), 4, 2)


@query("random_partition", sql(f"SELECT part, count(*) AS edges FROM (SELECT a.p AS part FROM ug JOIN (SELECT node, ntile(4) OVER (ORDER BY {md5(12, 'node')}) AS p FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug)) a ON a.node = u JOIN (SELECT node, ntile(4) OVER (ORDER BY {md5(12, 'node')}) AS p FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug)) b ON b.node = v AND a.p = b.p) GROUP BY 1", "ug"))
def _(spark, sf):
    from edgeloom.operators.order import running

    e = V.user_graph(spark, sf)
    n = running(E.nodes(e), [E.key("node", seed=12)], pos="i")
    total = n.count()
    big = total % 4 * (total // 4 + 1)
    i = F.col("i") - 1
    part = F.when(i < big, F.floor(i / (total // 4 + 1))).otherwise(total % 4 + F.floor((i - big) / max(1, total // 4))) + 1
    n = n.select("node", part.cast("long").alias("part"))
    return E.with_ends(e, n, "part").where("part_u = part_v").groupBy(F.col("part_u").alias("part")).agg(F.count("*").alias("edges"))


@query("bernoulli_partition", sql(f"WITH n AS (SELECT node, floor({u01(13, 'node')} * 4)::BIGINT AS part FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug)), l AS (SELECT node, part, row_number() OVER (PARTITION BY part ORDER BY node) - 1 AS i FROM n) SELECT a.part, a.i AS iu, b.i AS iv FROM ug JOIN l a ON a.node = u JOIN l b ON b.node = v WHERE a.part = b.part", "ug"))
def _(spark, sf):
    e = V.user_graph(spark, sf)
    n = E.nodes(e).withColumn("part", F.floor(E.uniform("node", seed=13) * 4))
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("node")).cast("long") - 1)
    return E.with_ends(e, n, "part", "i").where("part_u = part_v").select(F.col("part_u").alias("part"), F.col("i_u").alias("iu"), F.col("i_v").alias("iv"))
