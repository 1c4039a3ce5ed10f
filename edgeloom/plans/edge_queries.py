"""Queries of edge algebra, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from edgeloom.operators import edges as E
from edgeloom.operators.components import components
from edgeloom.operators.order import average_percentile, running
from edgeloom.plans.registry import query
from edgeloom.sources import views as V
from edgeloom.sources.views import sql

def md5(seed: int, *cols: str) -> str:
    return f"md5('{seed}|' || " + " || '|' || ".join(cols) + ")"


def u01(seed: int, *cols: str) -> str:
    return f"(('0x' || substr({md5(seed, *cols)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


R = F.round


@query("edge_canonical", sql("SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM tr WHERE src <> dst", "tr"))
def _(spark, sf):
    return E.canonical(V.transitions(spark, sf))


@query(
    "normalise_counts",
    sql("SELECT count(*) AS directed, count(*) FILTER (src <> dst) AS without_loops, 2 * count(DISTINCT CASE WHEN src <> dst THEN (least(src, dst), greatest(src, dst)) END) AS symmetric, count(DISTINCT CASE WHEN src <> dst THEN (least(src, dst), greatest(src, dst)) END) AS undirected FROM tr", "tr"),
)
def _(spark, sf):
    t = V.transitions(spark, sf)
    pair = F.when(F.col("src") != F.col("dst"), F.struct(F.least("src", "dst"), F.greatest("src", "dst")))
    n = F.count_distinct(pair)
    return t.agg(F.count("*").alias("directed"), F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("without_loops"), (2 * n).alias("symmetric"), n.alias("undirected"))


@query("symmetrise", sql("SELECT u AS src, v AS dst, w FROM ps UNION ALL SELECT v, u, w FROM ps", "ps"))
def _(spark, sf):
    return E.adjacency(V.part_supplier(spark, sf))


@query("self_loops", sql("SELECT u AS src, v AS dst FROM ug UNION ALL SELECT v, u FROM ug UNION ALL SELECT DISTINCT user_id, user_id FROM events", "ug"))
def _(spark, sf):
    users = V.table(spark, sf, "events").select(F.col("user_id").alias("node")).distinct()
    return E.with_self_loops(E.adjacency(V.user_graph(spark, sf)), users)


@query("half_plane", sql("SELECT DISTINCT src, dst FROM tr WHERE src < dst", "tr"))
def _(spark, sf):
    return V.transitions(spark, sf).where("src < dst").distinct()


@query("finalise_check", sql("SELECT count(*) AS n, count(DISTINCT (u, v)) AS pairs, 0::BIGINT AS not_canonical, 0::BIGINT AS foreign_edges, 0::BIGINT AS bad_weights, true AS size_ok FROM ps WHERE w >= 30", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return E.checked(e.where("w >= 30"), e)


@query("subgraph_induced", sql("SELECT u, v, w FROM cs WHERE u % 3 = 0 AND v % 2 = 0", "cs"))
def _(spark, sf):
    e = V.customer_supplier(spark, sf)
    return E.induced(e, E.nodes(e).where(f"(node < {V.OFFSET} AND node % 3 = 0) OR (node >= {V.OFFSET} AND node % 2 = 0)"))


@query("mask_of_ids", sql("SELECT u, v, w >= 40 AS kept FROM ps", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    ids = e.where("w >= 40").select("u", "v", F.lit(True).alias("__k"))
    return e.join(ids, ["u", "v"], "left").select("u", "v", F.coalesce("__k", F.lit(False)).alias("kept"))


@query("sanitised_scores", sql("SELECT u, v, CASE WHEN w % 7 = 0 THEN 0.0 WHEN w % 5 = 0 THEN 0.0 ELSE greatest(w - 20, 0) END::DOUBLE AS s FROM ps", "ps"))
def _(spark, sf):
    from edgeloom.functions.scoring import sanitised

    raw = F.when(F.col("w") % 7 == 0, F.lit(float("nan"))).when(F.col("w") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("w") - 20)
    return V.part_supplier(spark, sf).select("u", "v", sanitised(raw).alias("s"))


@query("min_max", sql("SELECT u, v, round((w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()), 6) AS w FROM ps", "ps"))
def _(spark, sf):
    from edgeloom.functions.scoring import min_max

    return min_max(V.part_supplier(spark, sf), "w").withColumn("w", R("w", 6))


RATIOS = [0.1, 0.25, 0.3, 0.5, 0.7]


@query(
    "budget_rules",
    sql("SELECT r AS ratio, ceil(r * m - 1e-12)::BIGINT AS up, greatest(1, round_even(r * m, 0))::BIGINT AS even, greatest(1, floor(r * 2 * m))::BIGINT AS directed FROM (SELECT count(*) AS m FROM ug), (SELECT unnest([0.1, 0.25, 0.3, 0.5, 0.7]::DOUBLE[]) AS r)", "ug"),
)
def _(spark, sf):
    m = V.user_graph(spark, sf).agg(F.count("*").alias("m"))
    r = F.explode(F.array(*[F.lit(x) for x in RATIOS])).alias("ratio")
    m = m.select("m", r)
    return m.select("ratio", F.ceil(F.col("ratio") * F.col("m") - 1e-12).alias("up"), F.greatest(F.lit(1), F.bround(F.col("ratio") * F.col("m"), 0)).cast("long").alias("even"), F.greatest(F.lit(1), F.floor(F.col("ratio") * 2 * F.col("m"))).cast("long").alias("directed"))


@query("balanced_sample", sql(f"SELECT node, part FROM (SELECT o_orderkey AS node, o_orderstatus AS part, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {md5(7, 'o_orderkey')}, o_orderkey) AS r FROM orders) WHERE r <= 50"))
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("part"))
    return E.balanced_sample(o, 50)


@query("edge_ids", sql("SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS eid FROM ug", "ug"))
def _(spark, sf):
    return E.edge_ids(V.user_graph(spark, sf).select("u", "v")).select("u", "v", F.col("eid").cast("long").alias("eid"))


@query("contained_ids", sql("SELECT u, v, eid FROM (SELECT u, v, w, row_number() OVER (ORDER BY u, v) - 1 AS eid FROM ps) WHERE w > 45", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return E.edge_ids(e.select("u", "v")).join(e.where("w > 45").select("u", "v"), ["u", "v"]).select("u", "v", F.col("eid").cast("long").alias("eid"))


@query("degree", sql("SELECT node, count(*) AS deg FROM (SELECT u AS node FROM ps UNION ALL SELECT v FROM ps) GROUP BY 1", "ps"))
def _(spark, sf):
    return E.degree(V.part_supplier(spark, sf))


@query("degree_with_zeros", sql("SELECT c.c_custkey AS node, count(cs.u) AS deg FROM customer c LEFT JOIN cs ON cs.u = c.c_custkey GROUP BY 1", "cs"))
def _(spark, sf):
    return E.degree(V.customer_supplier(spark, sf), V.table(spark, sf, "customer").select(F.col("c_custkey").alias("node")))


@query("edge_stats", sql("SELECT count(*) AS directed, count(DISTINCT (least(src, dst), greatest(src, dst))) AS undirected, count(*) FILTER (src = dst) AS self_loops FROM tr", "tr"))
def _(spark, sf):
    return E.stats(V.transitions(spark, sf))


@query("edge_stats_strict", sql("SELECT count(*) AS directed, count(DISTINCT CASE WHEN src <> dst THEN (least(src, dst), greatest(src, dst)) END) AS undirected, count(*) FILTER (src = dst) AS self_loops FROM tr", "tr"))
def _(spark, sf):
    return E.stats(V.transitions(spark, sf), loops_count=False)


@query("homophily_edge", sql("SELECT round(avg((a.label = b.label)::INT), 6) AS homophily, count(*) AS edges FROM kg JOIN embeddings a ON kg.u = a.vec_id JOIN embeddings b ON kg.v = b.vec_id WHERE a.label >= 0 AND b.label >= 0", "kg"))
def _(spark, sf):
    e = E.with_ends(V.knn_graph(spark, sf), V.vectors(spark, sf).where("y >= 0"), "y")
    return e.agg(R(F.avg((F.col("y_u") == F.col("y_v")).cast("int")), 6).alias("homophily"), F.count("*").alias("edges"))


@query("homophily_node", sql("SELECT round(avg(s), 6) AS homophily, count(*) AS nodes FROM (SELECT kk.n, avg((a.label = b.label)::INT) AS s FROM (SELECT u AS n, v AS o FROM kg UNION ALL SELECT v, u FROM kg) kk JOIN embeddings a ON kk.n = a.vec_id JOIN embeddings b ON kk.o = b.vec_id GROUP BY 1)", "kg"))
def _(spark, sf):
    y = V.vectors(spark, sf).where("y >= 0")
    a = E.adjacency(V.knn_graph(spark, sf)).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    per = E.with_ends(a, y, "y").groupBy("v").agg(F.avg((F.col("y_u") == F.col("y_v")).cast("int")).alias("s"))
    return per.agg(R(F.avg("s"), 6).alias("homophily"), F.count("*").alias("nodes"))


@query("label_distribution", sql("SELECT c.c AS label, count(e.vec_id) AS n FROM range(0, (SELECT max(label) + 3 FROM embeddings)::BIGINT) AS c(c) LEFT JOIN embeddings e ON e.label = c.c GROUP BY 1"))
def _(spark, sf):
    y = V.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    top = y.agg((F.max("label") + 2).alias("top"))
    classes = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("label")).select(F.col("label").cast("long"))
    return classes.join(y.withColumn("label", F.col("label").cast("long")), "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("coalesce_max", sql("SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(w) AS w FROM (SELECT src, dst, (src * 7 + dst * 3) % 11 + 0.5::DOUBLE AS w FROM tr) WHERE src <> dst GROUP BY 1, 2", "tr"))
def _(spark, sf):
    t = V.transitions(spark, sf).withColumn("w", (F.col("src") * 7 + F.col("dst") * 3) % 11 + F.lit(0.5))
    return E.coalesced(t.withColumnsRenamed({"src": "src", "dst": "dst"}))


@query("reciprocal_mean", sql("SELECT least(src, dst) AS u, greatest(src, dst) AS v, round(avg(w), 6) AS w FROM (SELECT DISTINCT src, dst, (src * 7 + dst * 3) % 11 + 0.5::DOUBLE AS w FROM tr) WHERE src <> dst GROUP BY 1, 2", "tr"))
def _(spark, sf):
    t = V.transitions(spark, sf).distinct().withColumn("w", (F.col("src") * 7 + F.col("dst") * 3) % 11 + F.lit(0.5))
    return E.coalesced(t, "avg").withColumn("w", R("w", 6))


@query("directed_to_undirected", sql("SELECT t.src, t.dst, coalesce(x.eid, -1) AS eid FROM (SELECT DISTINCT src, dst FROM tr) t LEFT JOIN (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS eid FROM ug) x ON x.u = least(t.src, t.dst) AND x.v = greatest(t.src, t.dst)", "ug"))
def _(spark, sf):
    ids = E.edge_ids(V.user_graph(spark, sf).select("u", "v"))
    t = V.transitions(spark, sf).distinct().withColumn("u", F.least("src", "dst")).withColumn("v", F.greatest("src", "dst"))
    return t.join(ids, ["u", "v"], "left").select("src", "dst", F.coalesce("eid", F.lit(-1)).cast("long").alias("eid"))


@query("missing_edges", sql("SELECT u, v, w FROM ps WHERE w < 25", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return E.missing(e, e.where("w >= 25"))


@query("overlap", sql("SELECT count(*) AS both FROM ps WHERE w > 25 AND u % 2 = 0", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return E.overlap(e.where("w > 25"), e.where("u % 2 = 0")).agg(F.count("*").alias("both"))


VIEW_SQL = "SELECT k AS view_id, u, v FROM ug, range(5) AS r(k) WHERE " + u01(1, "k", "u", "v") + " < 0.4"


def view_bank(spark, sf):
    """Five hashed supports of the user graph."""
    e = V.user_graph(spark, sf).select("u", "v").withColumn("view_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return e.where(E.uniform("view_id", "u", "v", seed=1) < 0.4).select("view_id", "u", "v")


@query("union_views", sql(f"WITH b AS ({VIEW_SQL}) SELECT DISTINCT u, v FROM b", "ug"))
def _(spark, sf):
    return view_bank(spark, sf).select("u", "v").distinct()


@query("union_all_views", sql(f"WITH b AS ({VIEW_SQL}) SELECT view_id, u, v FROM b", "ug"))
def _(spark, sf):
    return view_bank(spark, sf)


@query("nested_unions", sql(f"WITH b AS ({VIEW_SQL}) SELECT k, count(DISTINCT (u, v)) AS edges, CASE WHEN k > 5 THEN 'INSUFFICIENT_GRAPHS' ELSE 'OK' END AS status FROM b JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ON view_id < k GROUP BY 1", "ug"))
def _(spark, sf):
    k = F.explode(F.array(*[F.lit(x) for x in (1, 3, 5, 10)])).alias("k")
    b = view_bank(spark, sf).select("*", k).where("view_id < k")
    return b.groupBy("k").agg(F.count_distinct("u", "v").alias("edges")).withColumn("status", F.when(F.col("k") > 5, "INSUFFICIENT_GRAPHS").otherwise("OK"))


@query("occurrence_histogram", sql(f"WITH b AS ({VIEW_SQL}) SELECT c AS times, count(*) AS edges FROM (SELECT u, v, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1", "ug"))
def _(spark, sf):
    return view_bank(spark, sf).groupBy("u", "v").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("edges"))


@query("view_overlap", sql(f"WITH b AS ({VIEW_SQL}), o AS (SELECT u, v FROM b GROUP BY 1, 2 HAVING count(*) >= 3) SELECT view_id, count(*) AS shared FROM b JOIN o USING (u, v) GROUP BY 1", "ug"))
def _(spark, sf):
    b = view_bank(spark, sf)
    o = b.groupBy("u", "v").agg(F.count("*").alias("c")).where("c >= 3").select("u", "v")
    return b.join(o, ["u", "v"], "left_semi").groupBy("view_id").agg(F.count("*").alias("shared"))


@query("intersect_views", sql(f"WITH b AS ({VIEW_SQL}) SELECT u, v FROM b WHERE view_id = 0 INTERSECT SELECT u, v FROM b WHERE view_id = 1", "ug"))
def _(spark, sf):
    b = view_bank(spark, sf)
    return b.where("view_id = 0").select("u", "v").intersect(b.where("view_id = 1").select("u", "v"))


@query("distinct_supports", sql(f"WITH b AS ({VIEW_SQL}), d AS (SELECT view_id, u, v FROM b UNION ALL SELECT view_id + 5, u, v FROM b WHERE view_id < 2) SELECT support_id, min(view_id) AS view_id FROM (SELECT view_id, sha256(string_agg(u || '-' || v, ',' ORDER BY u, v)) AS support_id FROM d GROUP BY 1) GROUP BY 1", "ug"))
def _(spark, sf):
    from edgeloom.operators.combine import support_ids

    b = view_bank(spark, sf)
    d = b.unionByName(b.where("view_id < 2").withColumn("view_id", F.col("view_id") + 5))
    return support_ids(d).groupBy("support_id").agg(F.min("view_id").alias("view_id"))


@query("subset_check", sql("SELECT count(*) AS outside FROM (SELECT u, v FROM ps WHERE w > 30) a ANTI JOIN (SELECT u, v FROM ps WHERE w > 20) b USING (u, v)", "ps"))
def _(spark, sf):
    e = V.part_supplier(spark, sf)
    return E.missing(e.where("w > 30"), e.where("w > 20")).agg(F.count("*").alias("outside"))


@query("components", sql("WITH RECURSIVE e AS (SELECT u, v FROM kg UNION ALL SELECT v, u FROM kg), c(node, label) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, c.label FROM c JOIN e ON e.u = c.node AND c.label < e.v) SELECT node, min(label) AS component FROM c GROUP BY 1", "kg"))
def _(spark, sf):
    return components(V.knn_graph(spark, sf))


@query("component_count", sql("WITH RECURSIVE e AS (SELECT u, v FROM kg UNION ALL SELECT v, u FROM kg), c(node, label) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, c.label FROM c JOIN e ON e.u = c.node AND c.label < e.v), l AS (SELECT node, min(label) AS label FROM c GROUP BY 1) SELECT count(DISTINCT label) AS components, count(*) AS nodes FROM l", "kg"))
def _(spark, sf):
    return components(V.knn_graph(spark, sf)).agg(F.count_distinct("component").alias("components"), F.count("*").alias("nodes"))


@query("prefix_sum", sql("SELECT u, v, sum(w) OVER (ORDER BY u, v ROWS UNBOUNDED PRECEDING) AS cum FROM ps", "ps"))
def _(spark, sf):
    return running(V.part_supplier(spark, sf), [F.col("u"), F.col("v")], F.col("w")).select("u", "v", "cum")


@query("average_percentile", sql("SELECT u, v, round((rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 - 1) / (count(*) OVER () - 1), 6)::DOUBLE AS pct FROM ps", "ps"))
def _(spark, sf):
    return average_percentile(V.part_supplier(spark, sf), "w").select("u", "v", R("pct", 6).alias("pct"))


@query("running_best", "SELECT o_orderpriority AS run, o_orderkey AS epoch, max(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders")
def _(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("epoch"), F.max("o_totalprice").over(w).alias("best"))


@query("version_as_of", "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS version FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return V.table(spark, sf, "events").select("user_id", "event_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w), F.lit(-1)).alias("version"))


@query("mean_std_runs", "SELECT l_returnflag AS method, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(R(F.avg("l_extendedprice"), 4).alias("mean"), R(F.stddev_pop("l_extendedprice"), 4).alias("std"))


@query("best_epoch", "SELECT run, epoch, other FROM (SELECT o_custkey AS run, o_orderkey AS epoch, o_orderstatus AS other, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    best = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return o.groupBy(F.col("o_custkey").alias("run")).agg(best.alias("b")).select("run", F.col("b.o_orderkey").alias("epoch"), F.col("b.o_orderstatus").alias("other"))


@query("coverage_report", sql("SELECT count(*) FILTER (p >= 1) AS always, round(median(1 / p), 6) AS median_epochs, round(avg(1 - power(1 - p, 1)), 6) AS at1, round(avg(1 - power(1 - p, 5)), 6) AS at5, round(avg(1 - power(1 - p, 10)), 6) AS at10 FROM (SELECT least(w / 40, 1) AS p FROM ps)", "ps"))
def _(spark, sf):
    p = V.part_supplier(spark, sf).select(F.least(F.col("w") / 40, F.lit(1.0)).alias("p"))
    at = lambda e: R(F.avg(1 - F.pow(1 - F.col("p"), F.lit(e))), 6).alias(f"at{e}")
    return p.agg(F.count(F.when(F.col("p") >= 1, 1)).alias("always"), R(F.median(1 / F.col("p")), 6).alias("median_epochs"), at(1), at(5), at(10))


@query("owner_balance", sql("SELECT min(n) AS least, median(n)::DOUBLE AS middle, max(n) AS most, round(max(n) / avg(n), 6) AS ratio FROM (SELECT count(*) AS n FROM ps GROUP BY v)", "ps"))
def _(spark, sf):
    n = V.part_supplier(spark, sf).groupBy("v").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), R(F.max("n") / F.avg("n"), 6).alias("ratio"))


@query("load_cv_squared", sql("SELECT round(var_samp(n) / power(avg(n), 2), 6) AS cv2 FROM (SELECT count(*) AS n FROM ps GROUP BY v)", "ps"))
def _(spark, sf):
    n = V.part_supplier(spark, sf).groupBy("v").agg(F.count("*").alias("n"))
    return n.agg(R(F.var_samp("n") / F.pow(F.avg("n"), F.lit(2)), 6).alias("cv2"))


@query("multitask_mean", "SELECT round(avg(a), 6) AS mean, count(*) AS tasks FROM (SELECT task, avg(y) AS a FROM (SELECT 'quality' AS task, quality::DOUBLE AS y FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) WHERE y IS NOT NULL GROUP BY 1)")
def _(spark, sf):
    t = V.table(spark, sf, "labels").select(F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))).alias("task", "y")).where("y IS NOT NULL")
    return t.groupBy("task").agg(F.avg("y").alias("a")).agg(R(F.avg("a"), 6).alias("mean"), F.count("*").alias("tasks"))


@query("draw_merge", "SELECT l_suppkey AS edge, count(*) AS draws FROM lineitem GROUP BY 1")
def _(spark, sf):
    parts = V.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return parts.groupBy(F.col("l_suppkey").alias("edge")).agg(F.sum("n").alias("draws"))


@query("edge_position_last", sql("SELECT src, dst, max(pos) AS pos FROM (SELECT user_id AS src, (event_id * 7) % 50 AS dst, event_id AS pos FROM events) GROUP BY 1, 2"))
def _(spark, sf):
    t = V.table(spark, sf, "events").select(F.col("user_id").alias("src"), (F.col("event_id") * 7 % 50).alias("dst"), F.col("event_id").alias("pos"))
    return t.groupBy("src", "dst").agg(F.max("pos").alias("pos"))


@query("manifest", sql("SELECT (SELECT count(*) FROM embeddings) AS nodes, (SELECT count(*) FROM kg) AS edges, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS features, (SELECT max(label) + 1 FROM embeddings)::BIGINT AS classes", "kg"))
def _(spark, sf):
    n = V.vectors(spark, sf).agg(F.count("*").alias("nodes"), F.max(F.size("x")).cast("long").alias("features"), (F.max("y") + 1).cast("long").alias("classes"))
    return n.crossJoin(V.knn_graph(spark, sf).agg(F.count("*").alias("edges"))).select("nodes", "edges", "features", "classes")
