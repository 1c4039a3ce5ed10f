"""Queries of forests by value, spanners, low-stretch trees, growth on clusters, moments, anchors, masks and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom.functions import scoring as S
from edgeloom.operators import balance as B
from edgeloom.operators import cluster as U
from edgeloom.operators import combine as K
from edgeloom.operators import edges as E
from edgeloom.operators import forest as T
from edgeloom.operators import growth as G
from edgeloom.operators import metrics as M
from edgeloom.operators import paths as P
from edgeloom.operators import select as C
from edgeloom.operators import sequential as Q
from edgeloom.operators import tree_score as X
from edgeloom.operators.selectors import selector
from edgeloom.plans.edge_queries import VIEW_SQL, R, md5, u01, view_bank
from edgeloom.plans.graph_queries import BFS, LOGITS, TREE, anchors, low_forest
from edgeloom.plans.registry import query
from edgeloom.plans.score_queries import ADJ, DEG
from edgeloom.session import shared_dir, stored
from edgeloom.sources import files
from edgeloom.sources import views as V
from edgeloom.sources.views import sql


def prim(g: str, order: str, name: str = "pr") -> str:
    """SQL for the forest of a connected graph that is smallest in a total order: the tree takes, from its smallest node on, the first edge that leaves it."""
    return (
        f"{name}(i, vis, u, v) AS (SELECT 0, [min(u)], NULL::BIGINT, NULL::BIGINT FROM {g} UNION ALL SELECT i, CASE WHEN list_contains(vis, u) THEN list_append(vis, v) ELSE list_append(vis, u) END, u, v FROM "
        f"(SELECT p.i + 1 AS i, p.vis, g.u, g.v, row_number() OVER (ORDER BY {order}) AS r FROM {name} p, {g} g WHERE list_contains(p.vis, g.u) <> list_contains(p.vis, g.v)) WHERE r = 1)"
    )


def forest_sql(g: str, order: str, *views: str) -> str:
    return sql(f"WITH RECURSIVE {prim(g, order)} SELECT u, v FROM pr WHERE u IS NOT NULL", *(views or (g,)))


@query("max_weight_edges", forest_sql("ug", "g.w DESC, g.u, g.v"))
def _(spark, sf):
    return T.spanning_forest(V.user_graph(spark, sf), [F.col("w").desc()]).select("u", "v")


@query("min_weight_edges", forest_sql("ug", "g.w, g.u, g.v"))
def _(spark, sf):
    return selector("mst")(V.user_graph(spark, sf)).select("u", "v")


@query("random_forest_edges", forest_sql("ug", f"{md5(3, 'g.u', 'g.v')}, g.u, g.v"))
def _(spark, sf):
    return T.random_forest(V.user_graph(spark, sf), 3).select("u", "v")


@query("input_order_edges", forest_sql("ug", "g.u, g.v"))
def _(spark, sf):
    return T.spanning_forest(V.user_graph(spark, sf), []).select("u", "v")


# A forest and the tree scores of the rest, for the flagship by value.
PRIM_FO = "fo AS (SELECT CASE WHEN list_contains(vis[:len(vis) - 1], u) THEN v ELSE u END AS node, CASE WHEN list_contains(vis[:len(vis) - 1], u) THEN u ELSE v END AS parent FROM pr WHERE u IS NOT NULL)"
FLAGSHIP = TREE.replace("fo AS (SELECT v AS node, min(u) AS parent FROM ug GROUP BY 1)", f"{prim('ug', 'g.w DESC, g.u, g.v')}, {PRIM_FO}").replace(
    "WHERE fo.node = g.v AND fo.parent = g.u)", "WHERE (fo.node = g.v AND fo.parent = g.u) OR (fo.node = g.u AND fo.parent = g.v))"
)


@query("fast_support_users", sql(FLAGSHIP.replace("vp + 1e-8) / (max(vp) OVER () + 1e-8)", "0 + 1.0)") + ", b AS (SELECT ceil(0.3 * count(*) - 1e-12)::BIGINT AS q FROM ug), n AS (SELECT count(*) AS n FROM fo) SELECT least(node, parent) AS u, greatest(node, parent) AS v FROM fo UNION ALL SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY round(score, 9) DESC, u, v) AS r FROM sc), b, n WHERE r <= q - n", "ug"))
def _(spark, sf):
    """The flagship on the user graph, which SQL can follow edge by edge."""
    e = stored(V.user_graph(spark, sf))
    return K.fast_support(e, E.budget(e.count(), 0.3), [F.col("w").desc()])


RANDSPT = f"{ADJ.format(g='ug')}, rt AS (SELECT src AS node FROM adj GROUP BY 1 ORDER BY {md5(4, 'src')}, 1 LIMIT 1), b(node, dist) AS (SELECT node, 0 FROM rt UNION SELECT a.dst, b.dist + 1 FROM b JOIN adj a ON a.src = b.node WHERE b.dist < 12), d AS (SELECT node, min(dist) AS dist FROM b GROUP BY 1)"


@query("shortest_path_forest", sql(f"WITH RECURSIVE {RANDSPT} SELECT least(src, dst) AS u, greatest(src, dst) AS v FROM (SELECT a.src, a.dst, row_number() OVER (PARTITION BY a.dst ORDER BY {md5(4, 'a.src', 'a.dst')}, a.src) AS r FROM adj a JOIN d x ON x.node = a.src JOIN d y ON y.node = a.dst AND y.dist = x.dist + 1) WHERE r = 1", "ug"))
def _(spark, sf):
    return selector("randspt")(V.user_graph(spark, sf), seed=4)


@query("layered_spanner")
def _(spark, sf):
    return U.layered_spanner(V.user_graph(spark, sf), 3, 1)


@query("adaptive_spanner", sql("SELECT greatest(1, round_even(0.3 * count(*), 0))::BIGINT AS edges FROM ug", "ug"))
def _(spark, sf):
    return selector("adaptive_spanner")(V.user_graph(spark, sf), 0.3, 1).agg(F.count("*").alias("edges"))


@query("resistance_until_distinct", sql("SELECT ceil(0.3 * count(*) - 1e-12)::BIGINT AS edges FROM ug", "ug"))
def _(spark, sf):
    return selector("er_fix")(V.user_graph(spark, sf), 0.3, 1).agg(F.count("*").alias("edges"))


DISTINCT = f"{DEG.format(g='ps')}, s AS (SELECT u, v, 1.0::DOUBLE / a.deg + 1.0::DOUBLE / b.deg AS s FROM ps JOIN dg a ON a.node = u JOIN dg b ON b.node = v), p AS (SELECT u, v, s / sum(s) OVER () AS p FROM s), c AS (SELECT u, v, sum(p) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS c FROM p), d AS (SELECT k, {u01(9, 'k')} * (SELECT max(c) FROM c) AS t FROM range(4000) AS r(k)), h AS (SELECT c.u, c.v, d.k FROM d ASOF JOIN c ON d.t < c.c), f AS (SELECT u, v, min(k) AS k FROM h GROUP BY 1, 2 ORDER BY k LIMIT 1500), l AS (SELECT max(k) AS k FROM f)"


@query("draws_until_distinct", sql(f"WITH {DISTINCT} SELECT h.u, h.v, count(*) AS n, any_value(l.k) + 1 AS draws FROM h, l WHERE h.k <= l.k GROUP BY 1, 2", "ps"))
def _(spark, sf):
    p = S.degree_probability(V.part_supplier(spark, sf)).select("u", "v", "p")
    d, draws = C.until_distinct(p, "p", 1500, [F.col("u"), F.col("v")], 9)
    return d.select("u", "v", "n", F.lit(draws).cast("long").alias("draws"))


# Growth on clusters: every edge of the user graph belongs to the cluster that owns it.

PARTS = 24
OWNED = f"cl AS (SELECT node, node % {PARTS} AS c FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug)), e AS (SELECT u, v, a.c AS cu, b.c AS cv FROM ug JOIN cl a ON a.node = u JOIN cl b ON b.node = v), l AS (SELECT cu AS c, count(*) AS n FROM e WHERE cu = cv GROUP BY 1), o AS (SELECT u, v, CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) OR (coalesce(a.n, 0) = coalesce(b.n, 0) AND cu <= cv) THEN cu ELSE cv END AS owner FROM e LEFT JOIN l a ON a.c = cu LEFT JOIN l b ON b.c = cv)"
#: The nodes less the components of each cluster.
TREES = f"{OWNED}, oa AS (SELECT owner, u AS x, v AS y FROM o UNION ALL SELECT owner, v, u FROM o), rc(owner, node, low) AS (SELECT DISTINCT owner, x, x FROM oa UNION SELECT rc.owner, oa.y, rc.low FROM rc JOIN oa ON oa.owner = rc.owner AND oa.x = rc.node AND rc.low < oa.y), lw AS (SELECT owner, node, min(low) AS low FROM rc GROUP BY 1, 2), ts AS (SELECT owner, count(*) - count(DISTINCT low) AS f FROM lw GROUP BY 1), mm AS (SELECT owner, count(*) AS m FROM o GROUP BY 1)"


def clusters_of(spark, sf):
    e = V.user_graph(spark, sf)
    o = U.owners(e, E.nodes(e).withColumn("cluster", F.pmod("node", F.lit(PARTS))))
    return stored(o.select("u", "v", F.lit(1.0).alias("w"), "owner"), "clusters")


def sizes(o, support):
    """Edges of each cluster's support; a stranger counts under no cluster."""
    s = support.join(o.select("u", "v", "owner"), ["u", "v"], "left")
    return s.groupBy("owner").agg(F.count("*").alias("edges"), F.count_distinct("u", "v").alias("distinct_edges"))


TREE_SIZES = sql(f"WITH RECURSIVE {TREES} SELECT owner, f AS edges, f AS distinct_edges FROM ts", "ug")
for name, pick in (
    ("low_stretch_tree", lambda o: Q.low_stretch_tree(o, group="owner")),
    ("greedy_low_stretch_tree", lambda o: G.greedy_low_stretch(o, group="owner")),
    ("local_low_stretch_tree", lambda o: G.local_low_stretch(o, 3, group="owner")),
    ("random_spanning_tree", lambda o: Q.uniform_tree(o, group="owner")),
):

    @query(name, TREE_SIZES)
    def _(spark, sf, pick=pick):
        o = clusters_of(spark, sf)
        return sizes(o, pick(o))


GROWN = sql(f"WITH RECURSIVE {TREES} SELECT owner, greatest(f, ceil(0.7 * m - 1e-12))::BIGINT AS edges, greatest(f, ceil(0.7 * m - 1e-12))::BIGINT AS distinct_edges FROM ts JOIN mm USING (owner)", "ug")
for name in ("support", "support_dilation", "support_greedy", "support_batch", "support_heap", "clustered_joint_dilation_congestion"):

    @query(f"grown_{name}", GROWN)
    def _(spark, sf, name=name):
        o = clusters_of(spark, sf)
        return sizes(o, selector(name)(o, 0.7, group="owner"))


@query("greedy_spanner")
def _(spark, sf):
    return Q.greedy_spanner(clusters_of(spark, sf), 3, group="owner")


BURNT = sql(f"WITH {OWNED}, mm AS (SELECT owner, count(*) AS m FROM o GROUP BY 1) SELECT owner, greatest(1, round_even(0.3 * m, 0))::BIGINT AS edges, greatest(1, round_even(0.3 * m, 0))::BIGINT AS distinct_edges FROM mm", "ug")


@query("rank_degree", BURNT)
def _(spark, sf):
    o = clusters_of(spark, sf)
    return sizes(o, Q.rank_degree(o, 0.3, group="owner"))


@query("forest_fire", BURNT)
def _(spark, sf):
    o = clusters_of(spark, sf)
    return sizes(o, Q.forest_fire(o, 0.3, group="owner"))


@query("swap_refinement", GROWN)
def _(spark, sf):
    """Exchanges in each cluster until none of a missing edge for a kept one is better."""
    o = clusters_of(spark, sf)
    s = stored(selector("support_batch")(o, 0.7, group="owner"))
    return sizes(o, Q.swapped(o.select("u", "v", "owner"), s, group="owner"))


# Moments of features

MOMENTS = (
    f"sg AS (SELECT i, k, CASE WHEN {md5(42, 'i', 'k')} < '8' THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END AS s FROM range(64) AS a(i), range(16) AS b(k)), "
    "xs AS (SELECT vec_id AS node, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS x FROM embeddings), "
    "zz AS (SELECT node, k, sum(x * s) AS z FROM xs JOIN sg USING (i) GROUP BY 1, 2), zn AS (SELECT node, k, z / greatest(sqrt(sum(z * z) OVER (PARTITION BY node)), 1e-12) AS z FROM zz), "
    "mo AS (SELECT node, k AS pos, z AS x FROM zn UNION ALL SELECT node, k + 16, z * z FROM zn)"
)
SUPPORTED = f"su AS (SELECT u, v FROM kg WHERE {u01(21, 'u', 'v')} < 0.4::DOUBLE), {DEG.format(g='kg')}, {ADJ.format(g='kg')}, {MOMENTS}, tg AS (SELECT node, 0.5::DOUBLE * deg AS t FROM dg), sa AS (SELECT u AS src, v AS dst FROM su UNION ALL SELECT v, u FROM su), sd AS (SELECT dg.node, count(sa.src) AS d FROM dg LEFT JOIN sa ON sa.src = dg.node GROUP BY 1), mn AS (SELECT src AS node, pos, avg(x) AS m FROM adj JOIN mo ON mo.node = adj.dst GROUP BY 1, 2), hv AS (SELECT src AS node, pos, sum(x) AS h FROM sa JOIN mo ON mo.node = sa.dst GROUP BY 1, 2), rs AS (SELECT mn.node, mn.pos, coalesce(h, 0) - t * m AS r FROM mn JOIN tg ON tg.node = mn.node LEFT JOIN hv ON hv.node = mn.node AND hv.pos = mn.pos)"


def moments(spark, sf):
    return stored(B.feature_moments(V.vectors(spark, sf), 64), "moments")


def balance_state(spark, sf):
    e = V.knn_graph(spark, sf)
    s = stored(C.bernoulli(e, 0.4, 21))
    m = moments(spark, sf)
    t = E.degree(e).select("node", (0.5 * F.col("deg")).alias("target"))
    return e, s, m, stored(B.residuals(e, s, t, m), "residuals")


def long_form(x):
    return x.select("node", F.posexplode("x").alias("pos", "value")).select("node", F.col("pos").cast("long").alias("pos"), R("value", 6).alias("value"))


@query("feature_moments", f"WITH {MOMENTS} SELECT node, pos, round(x, 6) + 0.0::DOUBLE AS value FROM mo")
def _(spark, sf):
    return long_form(moments(spark, sf))


@query("neighbour_moments", sql(f"WITH {ADJ.format(g='kg')}, {MOMENTS} SELECT src AS node, pos, round(avg(x), 6) + 0.0::DOUBLE AS value FROM adj JOIN mo ON mo.node = adj.dst GROUP BY 1, 2", "kg"))
def _(spark, sf):
    return long_form(B.neighbour_moments(V.knn_graph(spark, sf), moments(spark, sf)))


@query("addition_costs", sql(f"WITH {SUPPORTED}, ca AS (SELECT u, v FROM kg ANTI JOIN su USING (u, v)), en AS (SELECT u, v, u AS a, v AS b FROM ca UNION ALL SELECT u, v, v, u FROM ca), pt AS (SELECT u, v, a, sum(2 * r * x + x * x) AS q FROM en JOIN rs ON rs.node = a JOIN mo ON mo.node = b AND mo.pos = rs.pos GROUP BY 1, 2, 3) SELECT u, v, round(sum((2 * (d - t) + 1 + q) / (greatest(t, 1) * greatest(t, 1))), 5) + 0.0::DOUBLE AS cost FROM pt JOIN sd ON sd.node = a JOIN tg ON tg.node = a GROUP BY 1, 2", "kg"))
def _(spark, sf):
    e, s, m, state = balance_state(spark, sf)
    return B.addition_costs(E.missing(e, s).select("u", "v"), state, m).select("u", "v", R("cost", 5).alias("cost"))


@query("balance_objective", sql(f"WITH {SUPPORTED} SELECT (SELECT round(sum(power((d - t) / greatest(t, 1), 2)), 4) FROM sd JOIN tg USING (node) WHERE t > 0) AS degree_error, (SELECT round(sum(power(r / greatest(t, 1), 2)), 4) FROM rs JOIN tg USING (node) WHERE t > 0) AS moment_error", "kg"))
def _(spark, sf):
    *_, state = balance_state(spark, sf)
    return B.balance_objective(state).select(R("degree_error", 4).alias("degree_error"), R("moment_error", 4).alias("moment_error"))


# Paths, anchors and tasks

@query("tree_path_nodes", sql(TREE + " SELECT u, v, x AS node FROM pn", "ug"))
def _(spark, sf):
    """Every node on the tree path of every edge outside the forest."""
    e = stored(V.user_graph(spark, sf).select("u", "v"))
    low = low_forest(e)
    return X.tree_paths(E.missing(e, low), X.forest_arrays(low, E.nodes(e))).select("u", "v", "node")


@query("shortest_path_steps", sql(f"WITH RECURSIVE {RANDSPT}, up AS (SELECT a.dst AS node, min(a.src) AS parent FROM adj a JOIN d x ON x.node = a.src JOIN d y ON y.node = a.dst AND y.dist = x.dist + 1 GROUP BY 1), w(target, step, node) AS (SELECT node, 0, node FROM d UNION ALL SELECT w.target, w.step + 1, up.parent FROM w JOIN up USING (node)) SELECT target, step::BIGINT AS step, node FROM w", "ug"))
def _(spark, sf):
    """A shortest path from every node to one root, over the smallest parents."""
    e = stored(V.user_graph(spark, sf).select("u", "v"))
    root = E.nodes(e).orderBy(E.key("node", seed=4), "node").limit(1)
    return P.paths_to(e, root)


@query("aggregation_depth", sql(BFS.format(most=12) + ", w AS (SELECT node, max(dist) AS far, count(*) AS c FROM d GROUP BY 1) SELECT max(far)::BIGINT AS depth FROM w WHERE c = (SELECT count(DISTINCT source) FROM d)", "kg"))
def _(spark, sf):
    e = V.knn_graph(spark, sf)
    return P.aggregation_depth(e, anchors(spark, sf, e))


@query("retrieval_depth", sql(BFS.format(most=12) + ", q AS (SELECT dst AS node, src AS source FROM (SELECT n.node AS dst, s.source AS src, row_number() OVER (PARTITION BY n.node ORDER BY " + md5(8, "n.node", "s.source") + ") AS r FROM (SELECT DISTINCT node FROM d) n, (SELECT DISTINCT source FROM d) s) WHERE r = 1) SELECT max(dist)::BIGINT AS depth FROM d JOIN q USING (node, source)", "kg"))
def _(spark, sf):
    """Hops until each node reaches the one source that holds its key."""
    e = V.knn_graph(spark, sf)
    s = anchors(spark, sf, e)
    keys = E.nodes(e).crossJoin(F.broadcast(s.select(F.col("node").alias("source"))))
    asked = keys.groupBy("node").agg(F.min_by("source", E.key("node", "source", seed=8)).alias("source"))
    return P.distances(e, s).join(asked, ["source", "node"]).agg(F.max("dist").cast("long").alias("depth"))


@query("farthest_anchors")
def _(spark, sf):
    return P.farthest_anchors(V.knn_graph(spark, sf), 5, 3)


@query("anchor_labels", sql(BFS.format(most=12) + ", r AS (SELECT node, dense_rank() OVER (ORDER BY source) - 1 AS y, row_number() OVER (PARTITION BY node ORDER BY dist, source) AS r, dist FROM d) SELECT node, CASE WHEN dist = 0 THEN -1 ELSE y END::BIGINT AS y FROM r WHERE r = 1", "kg"))
def _(spark, sf):
    """The task of naming the nearest anchor; anchors themselves have no label."""
    e = V.knn_graph(spark, sf)
    return P.anchor_task(e, anchors(spark, sf, e))


BITS = f"src AS (SELECT node, CASE WHEN {md5(32, 'node')} < '8' THEN 1 ELSE -1 END AS b FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug) QUALIFY row_number() OVER (ORDER BY {md5(31, 'node')}, node) <= ((least(15, count(*) OVER () - 1) - 1) | 1))"


@query("global_sign", sql(f"WITH {BITS}, n AS (SELECT u AS node FROM ug UNION SELECT v FROM ug) SELECT n.node, coalesce(10.0 * b, 0)::DOUBLE AS x0, CASE WHEN b IS NULL THEN 0.0 ELSE 10.0 END::DOUBLE AS x1, CASE WHEN b IS NULL THEN (SELECT (sum(b) > 0)::BIGINT FROM src) ELSE -1 END AS y FROM n LEFT JOIN src ON src.node = n.node", "ug"))
def _(spark, sf):
    return P.global_sign_task(V.user_graph(spark, sf), 15, 31)


# Masks, layers, metrics

SOFT = f"sc AS (SELECT k AS layer, u, v, {u01(17, 'k', 'u', 'v')} AS s FROM ug, range(3) AS r(k)), q AS (SELECT count(*) AS m FROM ug)"
MASKS = (
    f"WITH {SOFT}, a AS (SELECT u, v FROM (SELECT *, row_number() OVER (ORDER BY s DESC, u, v) AS r FROM sc WHERE layer = 0), q WHERE r <= m // 2), "
    "b AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY s DESC, u, v) AS r FROM sc SEMI JOIN a USING (u, v) WHERE layer = 1), q WHERE r <= m // 3), "
    "c AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY s DESC, u, v) AS r FROM sc SEMI JOIN b USING (u, v) WHERE layer = 2), q WHERE r <= m // 4) "
    "SELECT 0::BIGINT AS layer, u, v FROM a UNION ALL SELECT 1, u, v FROM b UNION ALL SELECT 2, u, v FROM c"
)


@query("shrinking_masks", sql(MASKS, "ug"))
def _(spark, sf):
    e = V.user_graph(spark, sf)
    s = e.select("u", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("layer")).withColumn("s", E.uniform("layer", "u", "v", seed=17))
    m = e.count()
    return C.shrinking_masks(s, [m // 2, m // 3, m // 4])


@query("percentile_pruned", sql("WITH t AS (SELECT quantile_cont(w, 0.35) AS low, count(*) AS m FROM ug), k AS (SELECT u, v, w, m FROM ug, t WHERE w >= low), n AS (SELECT count(*) AS n FROM k) SELECT u, v FROM (SELECT u, v, m, row_number() OVER (ORDER BY w DESC, u, v) AS r FROM k), n WHERE r <= n - greatest(0, floor(m * 0.35)::BIGINT - (m - n))", "ug"))
def _(spark, sf):
    return C.percentile_pruned(V.user_graph(spark, sf), 35.0).select("u", "v")


@query("top_across_layers", sql("SELECT layer, u, v FROM (SELECT *, row_number() OVER (ORDER BY w DESC, layer, u, v) AS r FROM (SELECT 0::BIGINT AS layer, u, v, w FROM ug UNION ALL SELECT 1, u, v, w FROM ps)) WHERE r <= 900", "ug", "ps"))
def _(spark, sf):
    return C.across_layers([V.user_graph(spark, sf), V.part_supplier(spark, sf)], 900)


FANS = f"WITH {ADJ.format(g='ug')}, n0 AS (SELECT DISTINCT src FROM adj), h0 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {md5(5, 'src', 'dst')}, dst) AS r FROM adj SEMI JOIN n0 USING (src)) WHERE r <= 3), n1 AS (SELECT DISTINCT dst AS src FROM h0), h1 AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {md5(6, 'src', 'dst')}, dst) AS r FROM adj SEMI JOIN n1 USING (src)) WHERE r <= 2) SELECT 0 AS hop, src, dst FROM h0 UNION ALL SELECT 1, src, dst FROM h1"


@query("fan_out", sql(FANS, "ug"))
def _(spark, sf):
    e = stored(V.user_graph(spark, sf))
    return C.fan_out(E.adjacency(e), E.nodes(e), [3, 2], 5)


@query("walk_node_norms")
def _(spark, sf):
    e = stored(V.user_graph(spark, sf))
    return C.walk_norms(stored(C.walks(E.adjacency(e.select("u", "v")), E.nodes(e), 4, 2)), e)[0]


TASKS = "ta AS (SELECT c AS task, node, CASE WHEN (node + c) % 4 = 0 THEN NULL ELSE (y = c)::INT END AS y, round(a[c + 1], 6) AS s FROM lg, (SELECT unnest(range(0, 10))::INT AS c) WHERE view_id = 0)"


@query("multi_task_f1", f"WITH {LOGITS}, {TASKS}, k AS (SELECT task, count(*) FILTER (y = 1 AND s >= 0) AS tp, count(*) FILTER (y = 1) + count(*) FILTER (s >= 0) AS b FROM ta WHERE y IS NOT NULL GROUP BY 1) SELECT round(avg(CASE WHEN b > 0 THEN 2 * tp / b ELSE 0 END), 6) AS f1, count(*) AS tasks FROM k")
def _(spark, sf):
    return M.multi_task_f1(tasks_of(spark, sf)).select(R("f1", 6).alias("f1"), "tasks")


@query("multi_task_auc", f"WITH {LOGITS}, {TASKS}, r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY s) + (count(*) OVER (PARTITION BY task, s) - 1) / 2.0 AS k FROM ta WHERE y IS NOT NULL), a AS (SELECT task, (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY 1 HAVING sum(y) > 0 AND sum(1 - y) > 0) SELECT round(avg(auc), 6)::DOUBLE AS auc, count(*) AS tasks FROM a")
def _(spark, sf):
    t = tasks_of(spark, sf).where("y IS NOT NULL").select("task", "y", F.col("logit").alias("score"))
    return M.roc_auc(t).agg(R(F.avg("auc"), 6).alias("auc"), F.count("*").alias("tasks"))


def tasks_of(spark, sf):
    """Ten yes-or-no tasks of the first view's logits, a quarter of their labels missing."""
    from edgeloom.plans.graph_queries import logits

    s = logits(spark, sf).where("view_id = 0").select("node", "y", F.posexplode("logits").alias("task", "s"))
    y = F.when((F.col("node") + F.col("task")) % 4 != 0, (F.col("y") == F.col("task")).cast("int"))
    return s.select("task", y.alias("y"), R("s", 6).alias("logit"))


@query("gate_load", "WITH x AS (SELECT vec_id, unnest(range(0, 8))::INT AS expert, unnest(embedding[1:8]::DOUBLE[]) AS e FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, expert) AS r FROM x), l AS (SELECT expert, count(*) FILTER (r <= 2) AS load FROM r GROUP BY 1) SELECT round(var_samp(load) / (power(avg(load), 2) + 1e-10), 6) AS cv_squared FROM l")
def _(spark, sf):
    g = V.vectors(spark, sf).select(S.gated(F.slice("x", 1, 8), 2).alias("gates"))
    return M.cv_squared(M.gate_load(g), "load").select(R("cv_squared", 6).alias("cv_squared"))


CHEB = f"{DEG.format(g='kg')}, {ADJ.format(g='kg')}, x AS (SELECT src AS i, dst AS j, -1 / sqrt(a.deg * b.deg) AS w FROM adj JOIN dg a ON a.node = src JOIN dg b ON b.node = dst), t2 AS (SELECT i, j, sum(w) AS w FROM (SELECT x.i, y.j, 2 * x.w * y.w AS w FROM x JOIN x y ON x.j = y.i UNION ALL SELECT node, node, -1 FROM dg) GROUP BY 1, 2), t3 AS (SELECT i, j, sum(w) AS w FROM (SELECT x.i, t2.j, 2 * x.w * t2.w AS w FROM x JOIN t2 ON x.j = t2.i UNION ALL SELECT i, j, -w FROM x) GROUP BY 1, 2)"


@query("chebyshev_t3", sql(f"WITH {CHEB} SELECT i, j, round(w, 11) + 0.0::DOUBLE AS w FROM t3 WHERE abs(w) > 1e-9", "kg"))
def _(spark, sf):
    return S.gcn_chebyshev(V.knn_graph(spark, sf), 3)[3].where("abs(w) > 1e-9").select("i", "j", R("w", 11).alias("w"))


@query("metric_rows", "SELECT l_returnflag AS method, l_linestatus AS dataset, count(*) AS run FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    """Rows of a ledger, appended in two goes and read back."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("dataset")).agg(F.count("*").alias("run"))
    files.append_metrics(t.where("method = 'A'"), path)
    files.append_metrics(t.where("method <> 'A'"), path)
    return files.read_metrics(spark, path).select("method", "dataset", F.col("run").cast("long").alias("run"))


@query("ranked_bank", sql(f"WITH b AS ({VIEW_SQL}) SELECT view_id, u, v FROM b", "ug"))
def _(spark, sf):
    """A bank of views, written by view and read back."""
    path = f"{shared_dir(spark)}/bank-{uuid.uuid4().hex}"
    files.save_bank(view_bank(spark, sf), path)
    return files.load_bank(spark, path).select(F.col("view_id").cast("long").alias("view_id"), "u", "v")


@query("growth_trace", sql("WITH r AS (SELECT u, v, row_number() OVER (ORDER BY w DESC, u, v) AS r, count(*) OVER () AS m FROM ug) SELECT u, v, CASE WHEN r <= ceil(0.2 * m - 1e-12) THEN 0 WHEN r <= ceil(0.5 * m - 1e-12) THEN 1 ELSE 2 END AS step FROM r WHERE r <= ceil(0.8 * m - 1e-12)", "ug"))
def _(spark, sf):
    """When each edge comes into a support that grows by weight."""
    e = stored(V.user_graph(spark, sf))
    grow = lambda e, ratio: C.top_k(e, F.col("w"), E.budget(e.count(), ratio))
    return G.first_step(G.grown_path_trace(e, [0.2, 0.5, 0.8], grow))


@query("mixed_backbone", sql(f"WITH RECURSIVE {prim('ug', 'g.w DESC, g.u, g.v')}, {prim('ug', md5(2, 'g.u', 'g.v') + ', g.u, g.v', 'pb')} SELECT 0::BIGINT AS version, u, v FROM pr WHERE u IS NOT NULL UNION ALL SELECT 1, u, v FROM pb WHERE u IS NOT NULL", "ug"))
def _(spark, sf):
    """Versions of a support whose every third backbone is the forest of largest weight, others being hashed."""
    from edgeloom.streaming.refresh import mixed_backbone

    e = stored(V.user_graph(spark, sf))
    out = [mixed_backbone(e, v, 3, 1).select(F.lit(v).cast("long").alias("version"), "u", "v") for v in (0, 1)]
    return out[0].unionByName(out[1])


@query("bridged_forests", forest_sql("ug", "(g.u % 4 <> g.v % 4), g.w DESC, g.u, g.v"))
def _(spark, sf):
    """Forests of clusters, joined by the heaviest crossing edges until no more components join."""
    e = V.user_graph(spark, sf)
    return T.bridged_forest(e, E.nodes(e).withColumn("cluster", F.pmod("node", F.lit(4))), [F.col("w").desc()]).select("u", "v")

