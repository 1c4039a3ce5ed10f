"""Queries of modularity clusters, balanced partitions, supports kept in state, Laplacians, tickets, masks and attention."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom.functions import attention as N
from edgeloom.operators import balance as Q
from edgeloom.operators import cluster as U
from edgeloom.operators import edges as E
from edgeloom.operators import euler as L
from edgeloom.operators import masks as H
from edgeloom.operators import modularity as Y
from edgeloom.operators import partition as B
from edgeloom.operators import spectral as Z
from edgeloom.operators import tree_score as X
from edgeloom.operators.edges import uniform
from edgeloom.operators.forest import random_forest
from edgeloom.operators.selectors import selector
from edgeloom.plans.edge_queries import md5, u01
from edgeloom.plans.graph_queries import low_forest
from edgeloom.plans.registry import ORACLES, query
from edgeloom.session import shared_dir, stored
from edgeloom.sources import archive as R
from edgeloom.sources import views as V
from edgeloom.sources.views import sql
from edgeloom.streaming import state as A

#: Parts and slack of the registered partitions.
PARTS, SLACK = 8, 0.05


@query("modularity_clusters")
def _(spark, sf):
    return Y.modularity_clusters(V.knn_graph(spark, sf))


@query(
    "modularity_check",
    sql("SELECT count(DISTINCT u) AS nodes, (SELECT count(*) FROM kg) AS edges, true AS recomputed, true AS rises, true AS above_single FROM (SELECT u FROM kg UNION ALL SELECT v FROM kg)", "kg"),
)
def _(spark, sf):
    """The modularity kept by the moves against one computed from the edges, level by level; it rises and exceeds that of single nodes."""
    e = V.knn_graph(spark, sf)
    levels = Y.modularity_levels(e)
    again = [Y.modularity(e, at).first()["modularity"] for at, _ in levels]
    values = [q for _, q in levels]
    n = levels[-1][0].count()
    single = Y.modularity(e, levels[-1][0].select("node", F.col("node").alias("cluster"))).first()["modularity"]
    row = (n, e.count(), all(abs(a - b) < 1e-9 for a, b in zip(again, values)), values == sorted(values), values[-1] > single)
    return spark.createDataFrame([row], "nodes long, edges long, recomputed boolean, rises boolean, above_single boolean")


HALF = u01(0, "node").replace("'0|'", "(r // 2)::VARCHAR || '|'")
MOVES = f"""WITH RECURSIVE adj AS (SELECT u AS src, v AS dst, w FROM ug UNION ALL SELECT v, u, w FROM ug),
st AS (SELECT src AS node, sum(w) AS k FROM adj GROUP BY 1), tm AS (SELECT sum(w) AS m FROM ug),
it AS (SELECT 0 AS r, node, k, node AS c FROM st UNION ALL
  SELECT r + 1, node, k, CASE WHEN go AND gain > here + 1e-12 THEN cand ELSE own END FROM (
    SELECT r, node, k, own, cand, gain, max(CASE WHEN cand = own THEN gain END) OVER (PARTITION BY node) AS here,
           row_number() OVER (PARTITION BY node ORDER BY gain DESC, cand) AS place,
           CASE WHEN r % 2 = 0 THEN {HALF} < 0.5 ELSE {HALF} >= 0.5 END AS go
    FROM (SELECT h.r, h.node, h.k, h.c AS own, n.c AS cand, n.w - h.k * (t.tot - CASE WHEN n.c = h.c THEN h.k ELSE 0 END) / (2 * m) AS gain
          FROM it h JOIN (SELECT node, c, sum(w) AS w FROM (SELECT a.src AS node, i.c, a.w FROM adj a JOIN it i ON a.dst = i.node UNION ALL SELECT node, c, 0.0 FROM it) GROUP BY 1, 2) n ON n.node = h.node
          JOIN (SELECT c, sum(k) AS tot, count(*) AS members FROM it GROUP BY 1) t ON t.c = n.c
          JOIN (SELECT c, count(*) AS members FROM it GROUP BY 1) o ON o.c = h.c, tm
          WHERE n.c = h.c OR o.members > 1 OR t.members > 1 OR n.c < h.c))
  WHERE place = 1 AND r < 4)
SELECT node, c AS cluster FROM it WHERE r = 4"""


@query("modularity_moves", sql(MOVES, "ug"))
def _(spark, sf):
    """Four rounds of moves by halves from single nodes."""
    g = stored(Y.graph_of(V.user_graph(spark, sf)), "ug")
    m = g.agg(F.sum("w")).first()[0]
    adj, at = Y.both_ways(g), Y.strengths(g).withColumn("cluster", F.col("node"))
    for r in range(4):
        at = stored(Y.moved(Y._around(adj, at), at, m, Y.half(r)), "moves")
    return at.select("node", "cluster")


def matching_sql(g: str, rounds: int) -> str:
    free, ctes = g, []
    for r in range(rounds):
        order = f"row_number() OVER (PARTITION BY node ORDER BY w DESC, {md5(r, 'u', 'v')} DESC, u DESC, v DESC)"
        ctes.append(f"t{r} AS (SELECT u, v FROM (SELECT u, v, {order} AS p FROM (SELECT u AS node, u, v, w FROM {free} UNION ALL SELECT v, u, v, w FROM {free})) WHERE p = 1 GROUP BY 1, 2 HAVING count(*) = 2)")
        ctes.append(f"f{r} AS (SELECT * FROM {free} WHERE u NOT IN (SELECT u FROM t{r} UNION ALL SELECT v FROM t{r}) AND v NOT IN (SELECT u FROM t{r} UNION ALL SELECT v FROM t{r}))")
        free = f"f{r}"
    pairs = " UNION ALL ".join(f"SELECT v AS node, u AS cluster FROM t{r}" for r in range(rounds))
    return f"WITH {', '.join(ctes)}, up AS ({pairs}) SELECT n.node, coalesce(cluster, n.node) AS cluster FROM (SELECT u AS node FROM {g} UNION SELECT v FROM {g}) n LEFT JOIN up USING (node)"


@query("heavy_matching", sql(matching_sql("ug", 3), "ug"))
def _(spark, sf):
    """Three rounds of matching along the heaviest edges of both ends."""
    g = stored(Y.graph_of(V.user_graph(spark, sf)), "ug")
    sizes = g.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("size", F.lit(1))
    return B.matched(g, sizes, 2)


@query("balanced_partition")
def _(spark, sf):
    return B.balanced_partition(V.knn_graph(spark, sf), PARTS, SLACK)


@query(
    "partition_check",
    sql(f"SELECT count(DISTINCT u) AS nodes, least({PARTS}, count(DISTINCT u)) AS parts, true AS balanced, true AS below_bfs FROM (SELECT u FROM kg UNION ALL SELECT v FROM kg)", "kg"),
)
def _(spark, sf):
    """All nodes have a part, no part is too large, and less weight is cut than by clusters around the nodes of largest degree."""
    e = V.knn_graph(spark, sf)
    parts = stored(B.balanced_partition(e, PARTS, SLACK), "parts")
    held = parts.groupBy("part").agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.max("n").alias("most"), F.sum("n").alias("nodes")).first()
    bound = -(-(1 + SLACK) * held["nodes"] // PARTS)
    below = B.cut_weight(e, parts) < B.cut_weight(e, U.bfs_clusters(e, PARTS).toDF("node", "part"))
    return spark.createDataFrame([(held["nodes"], held["parts"], held["most"] <= bound, below)], "nodes long, parts long, balanced boolean, below_bfs boolean")


#: Clusters of the state queries, and the seed whose forest is kept.
CLUSTERS, KEPT = 3, 4
INNER = f"inn AS (SELECT u, v, u % {CLUSTERS} AS c FROM ug WHERE u % {CLUSTERS} = v % {CLUSTERS})"


def cluster_prim(seed: int, name: str) -> str:
    """SQL for the least forest of each (connected) cluster in a hashed order, from its smallest node on."""
    order = f"{md5(seed, 'g.u', 'g.v')}, g.u, g.v"
    return (
        f"{name}(i, c, vis, u, v) AS (SELECT 0, c, [min(u)], NULL::BIGINT, NULL::BIGINT FROM inn GROUP BY c UNION ALL SELECT i, c, CASE WHEN list_contains(vis, u) THEN list_append(vis, v) ELSE list_append(vis, u) END, u, v FROM "
        f"(SELECT p.i + 1 AS i, p.c, p.vis, g.u, g.v, row_number() OVER (PARTITION BY p.c ORDER BY {order}) AS r FROM {name} p JOIN inn g ON g.c = p.c AND list_contains(p.vis, g.u) <> list_contains(p.vis, g.v)) WHERE r = 1)"
    )


@query(
    "state_forests",
    sql(
        f"WITH RECURSIVE {INNER}, {cluster_prim(KEPT, 'a')}, {cluster_prim(KEPT + 1, 'b')} SELECT c AS cluster, 1::BIGINT AS version, {KEPT}::BIGINT AS seed, u, v FROM a WHERE u IS NOT NULL UNION ALL SELECT c, 2, {KEPT + 1}, u, v FROM b WHERE u IS NOT NULL",
        "ug",
    ),
)
def _(spark, sf):
    """The user graph streams in from four files, in any order; then each cluster is asked for the forest it keeps, and for one of another seed."""
    source, name = f"{shared_dir(spark)}/state-in-{uuid.uuid4().hex}", f"state-{uuid.uuid4().hex}"
    inner = A.clustered(V.user_graph(spark, sf), CLUSTERS, "modulo")
    inner.repartition(4, F.xxhash64("u", "v")).write.parquet(source)
    A.asked(spark, CLUSTERS, KEPT, KEPT + 1).coalesce(1).write.mode("append").parquet(source)
    return A.versions(spark, A.run_supports(spark, source, KEPT, name=name)).select("cluster", "version", "seed", "u", "v")


LAPLACE = "adj AS (SELECT u AS src, v AS dst, w FROM ug UNION ALL SELECT v, u, w FROM ug), dg AS (SELECT src AS node, sum(w) AS d FROM adj GROUP BY 1)"
#: Steps of the plain iteration in SQL: dense graphs settle soon, small sparse ones don't.
STEPS = "(SELECT CASE WHEN count(*) < 40 THEN 3000 ELSE 150 END FROM dg)"


def jacobi(b: str) -> str:
    """SQL that solves Laplacian systems by damped steps, one row a node and column, for sides ``b`` (node, j, b)."""
    return f"""it(i, node, j, x) AS (SELECT 0, node, j, 0.0::DOUBLE FROM {b} UNION ALL
  SELECT s.i + 1, s.node, s.j, s.x / 3 + (b.b + coalesce(n.y, 0)) / d.d * 2 / 3 FROM it s JOIN {b} b USING (node, j) JOIN dg d USING (node)
  LEFT JOIN (SELECT a.src AS node, t.j, sum(a.w * t.x) AS y FROM adj a JOIN it t ON t.node = a.dst GROUP BY 1, 2) n USING (node, j) WHERE s.i < {STEPS}),
x AS (SELECT node, j, x FROM it WHERE i = {STEPS})"""


@query(
    "edge_resistances",
    sql(
        f"WITH RECURSIVE {LAPLACE}, pr AS (SELECT row_number() OVER (ORDER BY w DESC, u, v) AS j, u, v FROM ug ORDER BY j LIMIT 8), bb AS (SELECT node, j, CASE WHEN node = u THEN 1.0 WHEN node = v THEN -1.0 ELSE 0.0 END AS b FROM dg, pr), "
        f"{jacobi('bb')} SELECT pr.u, pr.v, round(a.x - b.x, 6) AS resistance FROM pr JOIN x a ON a.node = pr.u AND a.j = pr.j JOIN x b ON b.node = pr.v AND b.j = pr.j",
        "ug",
    ),
)
def _(spark, sf):
    """Exact resistances of the eight heaviest edges."""
    e = stored(V.user_graph(spark, sf), "ug")
    pairs = [(r["u"], r["v"]) for r in e.orderBy(F.col("w").desc(), "u", "v").limit(8).collect()]
    return Z.pair_resistances(e, pairs).withColumn("resistance", F.round("resistance", 6))


SIGN = f"CASE WHEN substr({md5(0, 'u', 'v')}, j + 1, 1) < '8' THEN 1.0 ELSE -1.0 END"


@query(
    "sketched_resistance",
    sql(
        f"WITH RECURSIVE {LAPLACE}, ej AS (SELECT u, v, j, sqrt(w) / sqrt(24.0) * {SIGN} AS s FROM ug, range(24) AS r(j)), bb AS (SELECT node, j, sum(s) AS b FROM (SELECT u AS node, j, s FROM ej UNION ALL SELECT v, j, -s FROM ej) GROUP BY 1, 2), "
        f"{jacobi('bb')} SELECT u, v, round(sum((a.x - b.x) ** 2), 6) AS resistance FROM ug JOIN x a ON a.node = u JOIN x b ON b.node = v AND b.j = a.j GROUP BY 1, 2",
        "ug",
    ),
)
def _(spark, sf):
    """Resistances of all edges from 24 hashed projections, solved by conjugate gradients over the edge table."""
    return Z.sketched_resistances(V.user_graph(spark, sf), 24).withColumn("resistance", F.round("resistance", 6))


@query("laplacian_eigenvalues")
def _(spark, sf):
    """The two lowest and two highest distinct eigenvalues of the normalised Laplacian."""
    return Z.extreme_eigenvalues(V.user_graph(spark, sf), steps=60)


LOTTERY = """WITH RECURSIVE n AS (SELECT count(*) AS m, ceil(0.3 * count(*) - 1e-12)::BIGINT AS q FROM ug),
it(i, k, u, v, w) AS (SELECT 0, m, u, v, w FROM ug, n UNION ALL
  SELECT i + 1, k2, u, v, w FROM (SELECT i, k2, u, v, w, row_number() OVER (ORDER BY s DESC, u, v) AS r FROM (
    SELECT x.i, x.u, x.v, x.w, greatest(q, k - greatest(1, floor(0.25 * k)::BIGINT)) AS k2, x.w / sqrt((a.d * b.d)::DOUBLE) AS s
    FROM it x JOIN (SELECT node, count(*) AS d FROM (SELECT u AS node FROM it UNION ALL SELECT v FROM it) GROUP BY 1) a ON a.node = x.u
    JOIN (SELECT node, count(*) AS d FROM (SELECT u AS node FROM it UNION ALL SELECT v FROM it) GROUP BY 1) b ON b.node = x.v, n WHERE k > q)) WHERE r <= k2)
SELECT u, v FROM it WHERE i = (SELECT max(i) FROM it)"""


@query("lottery_ticket", sql(LOTTERY, "ug"))
def _(spark, sf):
    return selector("unified_lth")(V.user_graph(spark, sf), 0.3, rate=0.25)


ADMM = """WITH RECURSIVE n AS (SELECT ceil(0.3 * count(*) - 1e-12)::BIGINT AS q FROM ug),
it(i, u, v, s, w, d) AS (SELECT 0, u, v, w, w, 0.0::DOUBLE FROM ug UNION ALL
  SELECT i + 1, u, v, s, (s + 1.0 * (z - (d + w - z))) / 2.0, d + w - z FROM (
    SELECT it.*, CASE WHEN row_number() OVER (ORDER BY abs(w + d) DESC, u, v) <= q THEN w + d ELSE 0.0 END AS z FROM it, n WHERE i < 6))
SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY abs(w) DESC, u, v) AS r FROM it WHERE i = 6), n WHERE r <= q"""


@query("admm_mask", sql(ADMM, "ug"))
def _(spark, sf):
    return selector("unified_lth")(V.user_graph(spark, sf), 0.3, duals=6)


@query(
    "cached_split",
    "SELECT node, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.6) + floor(n * 0.2) THEN 'valid' ELSE 'test' END AS part FROM "
    f"(SELECT vec_id AS node, row_number() OVER (ORDER BY {md5(5, 'vec_id')}, vec_id) AS i, count(*) OVER () AS n FROM embeddings WHERE label >= 0)",
)
def _(spark, sf):
    """A split of the labelled vectors, written on the first call and read on the second."""
    root = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    labelled = V.vectors(spark, sf).select("node", "y")
    first = R.cached_split(labelled, "vectors", 5, 0.6, 0.2, root)
    again = R.cached_split(labelled, "vectors", 5, 0.6, 0.2, root)
    if first.inputFiles() != again.inputFiles():
        raise ValueError("the split was made twice")
    return again


#: Features of the registered attention; its directions stand in the SQL as numbers.
FEATURES, WIDTH = 24, 64


def attention_sql() -> str:
    w = ", ".join(f"({r}, [{', '.join(repr(float(x)) for x in row)}])" for r, row in enumerate(N.projections(FEATURES, WIDTH, 1)))
    return f"""WITH w(r, d) AS (VALUES {w}), x AS (SELECT vec_id AS node, list_transform(embedding::DOUBLE[], lambda e: e / sqrt(sqrt({WIDTH}.0))) AS x, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT node, r, exp(list_dot_product(x, d::DOUBLE[]) - list_dot_product(x, x) / 2) AS f, v[1] AS v0, v[2] AS v1 FROM x, w),
s AS (SELECT r, sum(f) AS z, sum(f * v0) AS s0, sum(f * v1) AS s1 FROM f GROUP BY 1)
SELECT node, round(sum(f * s0) / sum(f * z), 8) AS out0, round(sum(f * s1) / sum(f * z), 8) AS out1 FROM f JOIN s USING (r) GROUP BY 1"""


@query("kernel_attention", attention_sql())
def _(spark, sf):
    """Attention of the embeddings to each other; two places of the result."""
    t = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("node"), *[F.col("embedding").alias(c) for c in "qkv"])
    return N.kernel_attention(t, FEATURES, 1).select("node", F.round(F.col("out")[0], 8).alias("out0"), F.round(F.col("out")[1], 8).alias("out1"))


SHARES = [0.8, 0.6, 0.4]


def masks_sql() -> str:
    ctes, before = [], "sc"
    for i, share in enumerate(SHARES):
        ctes.append(
            f"m{i} AS (SELECT u, v, margin FROM (SELECT b.u, b.v, b.margin, row_number() OVER (ORDER BY b.margin DESC, b.u, b.v) AS r FROM "
            f"(SELECT u, v, 1.0 + (s - avg(s) OVER ()) * (0.01 / greatest(stddev_pop(s) OVER (), 0.001)) - 0.001 * (t * t * t + 20.0 * t) AS margin FROM (SELECT u, v, w + {u01(20 + i, 'u', 'v')} AS s, {u01(30 + i, 'u')} - 0.5 AS t FROM ug)) b "
            + (f"JOIN m{i - 1} USING (u, v)" if i else "")
            + f") WHERE r <= (SELECT floor({share} * count(*)) FROM ug))"
        )
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS layer, u, v, round(1 / (1 + exp(-margin / 0.1)), 9) AS soft FROM m{i}" for i in range(len(SHARES)))
    return f"WITH {', '.join(ctes)} {rows}"


@query("layered_masks", sql(masks_sql(), "ug"))
def _(spark, sf):
    """Three layers of scores of the user graph, a threshold a node, and budgets that shrink."""
    e = stored(V.user_graph(spark, sf), "ug")
    m = e.count()
    scores = thresholds = None
    for i in range(len(SHARES)):
        s = e.select(F.lit(i).alias("layer"), "u", "v", (F.col("w") + uniform("u", "v", seed=20 + i)).alias("s"))
        t = e.select(F.col("u").alias("node")).distinct().select(F.lit(i).alias("layer"), "node", (uniform("node", seed=30 + i) - 0.5).alias("t"))
        scores, thresholds = (s, t) if scores is None else (scores.unionAll(s), thresholds.unionAll(t))
    return H.layered_masks(scores, thresholds, [int(x * m) for x in SHARES]).withColumn("soft", F.round("soft", 9))


RATIOS = [0.5, 0.3, 0.2]


def gumbel_sql(seed: int, *cols: str) -> str:
    return f"(-ln(-ln(greatest({u01(seed, *cols)}, pow(2.0, -52)))))"


def normal_sql(seed: int, *cols: str) -> str:
    u = lambda k: f"greatest({u01(seed + k, *cols)}, pow(2.0, -52))"
    return f"(sqrt(-2.0 * ln({u(0)})) * cos({2 * 3.141592653589793!r} * {u(1)}))"


MIXTURE = f"""WITH x AS (SELECT vec_id AS node, embedding::DOUBLE[] AS x FROM embeddings),
gl AS (SELECT node, e, x[e + 1] + (ln(1 + exp(x[e + 4])) + 0.01) * CASE e WHEN 0 THEN {normal_sql(40, 'node')} WHEN 1 THEN {normal_sql(42, 'node')} ELSE {normal_sql(44, 'node')} END AS l FROM x, range(3) AS r(e)),
gk AS (SELECT node, e, l, row_number() OVER (PARTITION BY node ORDER BY l DESC, e) AS r, max(l) OVER (PARTITION BY node) AS t FROM gl),
g AS (SELECT node, e, exp(l - t) / sum(exp(l - t)) OVER (PARTITION BY node) AS g FROM gk WHERE r <= 2),
adj AS (SELECT u AS src, v AS dst FROM kg UNION ALL SELECT v, u FROM kg),
sx AS (SELECT src, dst, e, a.x[e + 1] * b.x[e + 1] + {gumbel_sql(50, 'src', 'dst', 'e')} AS y FROM adj JOIN x a ON a.node = src JOIN x b ON b.node = dst, range(3) AS r(e)),
p AS (SELECT src, dst, e, exp(y - max(y) OVER w) AS z, row_number() OVER (PARTITION BY src, e ORDER BY y DESC, dst) AS r, count(*) OVER w AS deg, max(y) OVER w AS t, y FROM sx WINDOW w AS (PARTITION BY src, e)),
k AS (SELECT src, dst, e, z / sum(z) OVER (PARTITION BY src, e) AS p, r, deg FROM p),
f AS (SELECT src, dst, g * p AS y FROM k JOIN g ON g.node = k.src AND g.e = k.e WHERE r <= ceil(({RATIOS}::DOUBLE[])[k.e + 1] * deg)),
s AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(y) / 2 AS soft FROM (SELECT src, dst, 0.0 AS y FROM adj UNION ALL SELECT * FROM f) GROUP BY 1, 2)
SELECT u, v, round(soft, 9) AS soft FROM s ORDER BY s.soft DESC, u, v LIMIT (SELECT floor(0.4 * count(*))::BIGINT FROM kg)"""


@query("expert_mixture", sql(MIXTURE, "kg"))
def _(spark, sf):
    """Three experts on places of the embeddings, two gates a node with noise, 40 % of the neighbour graph."""
    e = V.knn_graph(spark, sf)
    x = V.vectors(spark, sf)
    part = lambda a, n: F.slice("x", a + 1, n)
    gates = H.noisy_gates(x.select("node", part(0, 3).alias("logits"), part(3, 3).alias("spread")), 3, 2, 40)
    adj = E.adjacency(e.select("u", "v"))
    ends = adj.join(x.select(F.col("node").alias("src"), part(0, 3).alias("a")), "src").join(x.select(F.col("node").alias("dst"), part(0, 3).alias("b")), "dst")
    scores = ends.select("src", "dst", F.zip_with("a", "b", lambda p, q: p * q).alias("experts"))
    return H.expert_mixture(scores, gates, RATIOS, int(0.4 * e.count()), seed=50).withColumn("soft", F.round("soft", 9))


def _toured(spark, sf):
    """The user graph's edges, its low forest, and the tour of that."""
    e = stored(V.user_graph(spark, sf).select("u", "v"), "ug")
    low = stored(low_forest(e), "low")
    return e, low, L.Tour(low)


@query("tour_index", ORACLES["tree_index"])
def _(spark, sf):
    """The rooted index from tables; nodes outside the forest are roots."""
    e, _, tour = _toured(spark, sf)
    rest = E.nodes(e).join(tour.nodes, "node", "left_anti").select("node", F.lit(-1).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), F.col("node").alias("root"))
    return tour.nodes.select("node", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", "root").unionByName(rest)


@query("tour_ancestors", ORACLES["lowest_ancestor"])
def _(spark, sf):
    e, low, tour = _toured(spark, sf)
    found = tour.ancestors(E.missing(e, low)).where("lca IS NOT NULL")
    deep = lambda s: tour.nodes.select(F.col("node").alias(s), F.col("depth").alias(f"d{s}"))
    return found.join(deep("u"), "u").join(deep("v"), "v").join(deep("lca"), "lca").select("u", "v", "lca", (F.col("du") + F.col("dv") - 2 * F.col("dlca")).alias("hops"))


def _toured_congestion(spark, sf, which):
    e, low, tour = _toured(spark, sf)
    con = L.congestion(tour, tour.ancestors(E.missing(e, low)).where("lca IS NOT NULL"))
    return con.select("node", F.col(which).alias("congestion")).where("congestion > 0")


@query("tour_edge_congestion", ORACLES["edge_congestion"])
def _(spark, sf):
    return _toured_congestion(spark, sf, "e")


@query("tour_node_congestion", ORACLES["node_congestion"])
def _(spark, sf):
    return _toured_congestion(spark, sf, "v")


@query("tour_score", ORACLES["tree_score"])
def _(spark, sf):
    e, low, _ = _toured(spark, sf)
    s = X.scored(L.path_terms(e, low)).where("NOT mandatory")
    return s.select("u", "v", "hops", F.round("ep", 5).alias("ep"), F.round("vp", 5).alias("vp"), F.round("score", 6).alias("score"))


@query(
    "balanced_moments",
    sql("SELECT ceil(0.6 * count(*) - 1e-12)::BIGINT AS edges, ceil(0.6 * count(*) - 1e-12)::BIGINT AS of_graph, (SELECT count(*) FROM (SELECT u FROM kg UNION SELECT v FROM kg)) AS nodes, true AS falls FROM kg", "kg"),
)
def _(spark, sf):
    """60 % of the neighbour graph around a hashed forest, by degrees and moments of the embeddings: its size, edges of the graph, nodes touched, and that the objective falls in every round."""
    e = stored(V.knn_graph(spark, sf).select("u", "v"), "kg")
    moments = Q.feature_moments(V.vectors(spark, sf), 64, 8)
    log: list[float] = []
    kept = Q.completed(e, random_forest(e, 2), E.budget(e.count(), 0.6), moments, log=log)
    n, of = kept.count(), kept.join(e, ["u", "v"], "left_semi").distinct().count()
    return spark.createDataFrame([(n, of, E.nodes(kept).count(), all(b < a for a, b in zip(log, log[1:])))], "edges long, of_graph long, nodes long, falls boolean")
