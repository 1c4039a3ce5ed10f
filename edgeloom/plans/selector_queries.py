"""Queries of clusters, spanners, sequential selectors, resistance, the registry, refresh and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom.operators import cluster as U
from edgeloom.operators import edges as E
from edgeloom.operators import sequential as Q
from edgeloom.operators.selectors import selector
from edgeloom.plans.edge_queries import R
from edgeloom.plans.graph_queries import N_UG
from edgeloom.plans.registry import query
from edgeloom.plans.score_queries import ADJ
from edgeloom.session import shared_dir, stored
from edgeloom.sources import files
from edgeloom.sources import views as V
from edgeloom.sources.views import sql


@query("label_clusters", "SELECT vec_id AS node, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS f FROM embeddings)")
def _(spark, sf):
    return U.label_clusters(V.vectors(spark, sf)).select("node", F.col("cluster").cast("long").alias("cluster"))


@query("bfs_clusters")
def _(spark, sf):
    return U.bfs_clusters(V.knn_graph(spark, sf), 8)


@query("label_propagation")
def _(spark, sf):
    return U.label_propagation(V.knn_graph(spark, sf), 3)


OWN = "cl AS (SELECT node, node % 5 AS c FROM (SELECT u AS node FROM ug UNION SELECT v FROM ug)), e AS (SELECT u, v, a.c AS cu, b.c AS cv FROM ug JOIN cl a ON a.node = u JOIN cl b ON b.node = v), l AS (SELECT cu AS c, count(*) AS n FROM e WHERE cu = cv GROUP BY 1), o AS (SELECT u, v, CASE WHEN coalesce(a.n, 0) < coalesce(b.n, 0) OR (coalesce(a.n, 0) = coalesce(b.n, 0) AND cu <= cv) THEN cu ELSE cv END AS owner FROM e LEFT JOIN l a ON a.c = cu LEFT JOIN l b ON b.c = cv)"


def owned(spark, sf):
    e = V.user_graph(spark, sf)
    return U.owners(e, E.nodes(e).withColumn("cluster", F.col("node") % 5))


@query("edge_owners", sql(f"WITH {OWN} SELECT u, v, owner FROM o", "ug"))
def _(spark, sf):
    return owned(spark, sf).select("u", "v", "owner")


@query("cluster_budgets", sql(f"WITH {OWN}, c AS (SELECT owner, count(*) AS cap FROM o GROUP BY 1), t AS (SELECT owner, cap, least(700, sum(cap) OVER ()) AS b, cap * least(700, sum(cap) OVER ()) / sum(cap) OVER ()::DOUBLE AS raw FROM c), f AS (SELECT *, floor(round(raw, 9))::BIGINT AS fl FROM t) SELECT owner, cap, (fl + CASE WHEN row_number() OVER (ORDER BY (fl < cap)::INT DESC, round(raw - fl, 9) DESC, owner) <= b - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS give FROM f", "ug"))
def _(spark, sf):
    return U.cluster_budgets(owned(spark, sf), 700).select("owner", "cap", "give")


@query("fast_by_cluster", sql(f"WITH {OWN} SELECT least(700, count(*))::BIGINT AS edges FROM o", "ug"))
def _(spark, sf):
    o = owned(spark, sf)
    return U.fast_by_cluster(o, 700, o.select("u", "v", F.col("w").alias("s"))).agg(F.count("*").alias("edges"))


@query("three_spanner", sql(f"WITH RECURSIVE {ADJ.format(g='kg')} SELECT (SELECT count(*) FROM kg) AS edges, 3 AS most", "kg"))
def _(spark, sf):
    """Every edge's ends are at most three hops apart in the spanner."""
    e = stored(V.knn_graph(spark, sf).select("u", "v"))
    s = stored(U.three_spanner(e, 1))
    a = E.adjacency(s)
    one = a.select("src", "dst", F.lit(1).alias("d"))
    two = a.join(a.select(F.col("src").alias("dst"), F.col("dst").alias("x")), "dst").select("src", F.col("x").alias("dst"), F.lit(2).alias("d")).distinct()
    near = one.unionAll(two)
    three = two.join(a.select(F.col("src").alias("dst"), F.col("dst").alias("x")), "dst").select("src", F.col("x").alias("dst"), F.lit(3).alias("d")).distinct()
    d = e.join(near.unionAll(three).groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("d").alias("d")), ["u", "v"], "left")
    return d.agg(F.count("d").alias("edges"), F.greatest(F.max("d"), F.lit(3)).alias("most"))


@query("spanner_to_budget", sql("SELECT greatest(1, round_even(0.3 * count(*), 0))::BIGINT AS edges FROM kg", "kg"))
def _(spark, sf):
    return selector("las_vegas_spanner")(V.knn_graph(spark, sf), 0.3, 1).agg(F.count("*").alias("edges"))


@query("effective_resistance", sql(f"SELECT count(*) AS edges, round({N_UG}, 4)::DOUBLE AS total FROM ug", "ug"))
def _(spark, sf):
    """Leverage adds up to nodes less components."""
    e = V.user_graph(spark, sf)
    r = Q.resistance(e).join(e, ["u", "v"])
    return r.agg(F.count("*").alias("edges"), R(F.sum(F.col("resistance") * F.col("w")), 4).alias("total"))


@query("spectral_sample")
def _(spark, sf):
    return selector("effective_resistance")(V.user_graph(spark, sf), 0.3, 1)


@query("keyed_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM orders")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit(0.0).alias("score"))
    return files.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("score", F.lit(1.0)), ["o_orderkey"])


@query("artifact_round_trip", sql("SELECT u, v, w FROM ug", "ug"))
def _(spark, sf):
    e = V.user_graph(spark, sf)
    path = f"{shared_dir(spark)}/artifact-{uuid.uuid4().hex}"
    mark = files.fingerprint(e)
    files.save_artifact(e, path, {"version": 1, "graph": mark})
    return files.load_artifact(spark, path, version=1, graph=mark)


@query("encoded_columns", "WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS q, l_discount AS f, (l_returnflag = 'A')::INT::DOUBLE AS a, (l_returnflag = 'N')::INT::DOUBLE AS n, (l_returnflag = 'R')::INT::DOUBLE AS r FROM lineitem, m")
def _(spark, sf):
    t = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    x = files.encode_columns(t, ["l_quantity"], ["l_discount"], ["l_returnflag"])
    return x.select("l_orderkey", "l_linenumber", R(F.col("x")[0], 6).alias("q"), F.col("x")[1].alias("f"), F.col("x")[2].alias("a"), F.col("x")[3].alias("n"), F.col("x")[4].alias("r"))


@query("refresh_schedule", "SELECT e AS epoch, CASE WHEN e < 3 THEN -1 ELSE e // 3 - 1 END AS version FROM range(10) AS r(e)")
def _(spark, sf):
    from edgeloom.streaming.refresh import refresh_epochs, version_of

    due = refresh_epochs(10, 3)
    r = spark.createDataFrame([(e, i) for i, e in enumerate(due)], "epoch long, version long")
    return version_of(spark.range(10).withColumnRenamed("id", "epoch"), r)


@query("streamed_supports", "SELECT user_id AS src, count(*) AS edges FROM events GROUP BY 1")
def _(spark, sf):
    """Events read as a stream; each micro-batch writes a version, and the versions together hold every event."""
    from edgeloom.streaming.refresh import edge_stream, run_refresh

    schema = V.table(spark, sf, "events").schema
    stream = edge_stream(spark, f"{sf}/events.parquet*", schema)
    folder = run_refresh(stream, lambda b, i: b.groupBy("src").agg(F.count("*").alias("edges")), 1, f"supports-{uuid.uuid4().hex}")
    return spark.read.parquet(folder).groupBy("src").agg(F.sum("edges").alias("edges"))


@query("windowed_degrees", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id AS src, count(*) AS deg FROM events GROUP BY 1, 2")
def _(spark, sf):
    from edgeloom.streaming.refresh import windowed_degrees

    t = V.table(spark, sf, "events").select("ts", F.col("user_id").alias("src"))
    return windowed_degrees(t).select(F.col("w.start").alias("day"), "src", "deg")
