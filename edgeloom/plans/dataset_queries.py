"""Queries of datasets by name, tasks on graphs, candidates of growth steps, kept supports and re-ranked banks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgeloom.operators import combine as K
from edgeloom.operators import paths as P
from edgeloom.operators import select as C
from edgeloom.plans.edge_queries import md5, u01
from edgeloom.plans.registry import query
from edgeloom.session import shared_dir, stored
from edgeloom.sources import datasets as D
from edgeloom.sources import files as I
from edgeloom.sources import views as V
from edgeloom.sources.views import sql

#: Views of the registered bank, the share of edges that each holds, and sources of the retrieval task.
VIEWS, SHARE, SOURCES = 4, 0.5, 15
#: Candidates that a registered growth step looks at.
LOOKED_AT = 500


@query(
    "dataset_bundle",
    sql(
        f"""WITH s AS (SELECT node, CASE WHEN i <= floor(n * 0.5) THEN 'train' WHEN i <= floor(n * 0.5) + floor(n * 0.25) THEN 'valid' ELSE 'test' END AS part FROM
(SELECT vec_id AS node, row_number() OVER (ORDER BY {md5(42, 'vec_id')}, vec_id) AS i, count(*) OVER () AS n FROM embeddings WHERE label >= 0)),
d AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM kg UNION ALL SELECT v FROM kg) GROUP BY 1)
SELECT vec_id AS node, label::BIGINT AS y, part, coalesce(deg, 0)::BIGINT AS deg FROM embeddings LEFT JOIN s ON vec_id = s.node LEFT JOIN d ON vec_id = d.node""",
        "kg",
    ),
)
def _(spark, sf):
    """A dataset that is written as tables, then loaded by another name of its own: labels, random split and degrees."""
    root = f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}"
    pairs = V.nearest(V.vectors(spark, sf)).select("src", "dst")
    pairs.write.parquet(f"{root}/karate/edges")
    V.vectors(spark, sf).write.parquet(f"{root}/karate/nodes")
    d = D.load_dataset(spark, root, "KarateClub", split_protocol="native")
    deg = d.edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    out = d.nodes.join(d.splits, "node", "left").join(deg, "node", "left")
    return out.select("node", "y", "part", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


@query(
    "keyed_retrieval",
    sql(
        f"""WITH n AS (SELECT u AS node FROM kg UNION SELECT v FROM kg), r AS (SELECT node, row_number() OVER (ORDER BY {md5(6, 'node')}, node) - 1 AS j, count(*) OVER () AS n FROM n),
k AS (SELECT least({SOURCES}, greatest(max(n) // 2, 1)) AS k FROM r), s AS (SELECT node, j, CASE WHEN {md5(7, 'node')} < '8' THEN 1 ELSE 0 END AS bit FROM r, k WHERE j < k),
a AS (SELECT node, ('0x' || substr({md5(8, 'node')}, 1, 8))::BIGINT % k AS asks FROM r, k WHERE j >= k)
SELECT node, -1::BIGINT AS y, -1::BIGINT AS asked, (j + 1)::BIGINT AS mark, 10.0::DOUBLE * (2 * bit - 1) AS held FROM s
UNION ALL SELECT a.node, bit::BIGINT, s.node::BIGINT, (k + 1 + asks + 1)::BIGINT, 0.0::DOUBLE FROM a JOIN s ON asks = j, k""",
        "kg",
    ),
)
def _(spark, sf):
    """The retrieval task of the neighbour graph: what is asked, its answer, and where the features say so."""
    t = P.keyed_retrieval_task(V.knn_graph(spark, sf), SOURCES, 6)
    middle = F.element_at("x", ((F.size("x") + 1) / 2).cast("int"))
    return t.select("node", "y", F.coalesce("asked", F.lit(-1).cast("long")).alias("asked"), F.array_position("x", 10.0).cast("long").alias("mark"), middle.alias("held"))


@query(
    "candidate_sample",
    sql(
        f"""WITH c AS (SELECT u, v FROM ps WHERE w < 30), d AS (SELECT node, count(*) AS deg FROM (SELECT u AS node FROM ps WHERE w >= 30 UNION ALL SELECT v FROM ps WHERE w >= 30) GROUP BY 1),
p AS (SELECT u, v, 1 / coalesce(a.deg, 1)::DOUBLE + 1 / coalesce(b.deg, 1)::DOUBLE AS p FROM c LEFT JOIN d a ON u = a.node LEFT JOIN d b ON v = b.node)
SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY round(-ln(1 - {u01(9, 'u', 'v')}) / p, 9), u, v) AS r FROM p) WHERE r <= {LOOKED_AT}""",
        "ps",
    ),
)
def _(spark, sf):
    """What a growth step looks at when it prefers thin places."""
    e = stored(V.part_supplier(spark, sf), "candidates")
    return C.candidate_sample(e.where("w >= 30"), e.where("w < 30"), LOOKED_AT, "weighted", 9)


@query("consensus_artifact", sql("SELECT u, v FROM ps WHERE w >= 30", "ps"))
def _(spark, sf):
    """A support that is written, checked and read again."""
    path = f"{shared_dir(spark)}/consensus-{uuid.uuid4().hex}"
    I.save_consensus(V.part_supplier(spark, sf).where("w >= 30"), path, method="threshold")
    return I.load_consensus(spark, path)


def bank_sql() -> str:
    views = " UNION ALL ".join(f"SELECT {i} AS view_id, u, v FROM kg WHERE {u01(i, 'u', 'v')} < {SHARE}" for i in range(VIEWS))
    return f"""WITH x AS (SELECT vec_id AS node, label AS y, unnest(range(0, 64))::INT AS pos, unnest(embedding::DOUBLE[]) AS e FROM embeddings),
m AS (SELECT y AS label, pos, avg(e) AS c FROM x WHERE y >= 0 GROUP BY 1, 2), l AS (SELECT node AS dst, label, sum(e * c) AS s FROM x JOIN m USING (pos) GROUP BY 1, 2),
b AS ({views}), a AS (SELECT view_id, u AS src, v AS dst FROM b UNION ALL SELECT view_id, v, u FROM b UNION ALL SELECT view_id, vec_id, vec_id FROM embeddings, (SELECT DISTINCT view_id FROM b)),
g AS (SELECT view_id, src AS node, label, round(avg(s), 9) AS s FROM a JOIN l USING (dst) GROUP BY 1, 2, 3),
p AS (SELECT view_id, node, label, row_number() OVER (PARTITION BY view_id, node ORDER BY s DESC, label) AS r FROM g),
z AS (SELECT view_id, round(avg(CASE WHEN p.label = e.label THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS accuracy FROM p JOIN embeddings e ON node = vec_id WHERE r = 1 AND e.label >= 0 GROUP BY 1)
SELECT view_id::BIGINT AS view_id, accuracy, row_number() OVER (ORDER BY accuracy DESC, view_id)::BIGINT AS rank FROM z"""


@query("reranked_bank", sql(bank_sql(), "kg"))
def _(spark, sf):
    """Views of the neighbour graph judged by class means after one step over their edges."""
    n = stored(V.vectors(spark, sf), "bank-nodes")
    e = stored(V.knn_graph(spark, sf), "bank-edges")
    views = None
    for i in range(VIEWS):
        v = C.bernoulli(e, SHARE, i).select(F.lit(i).cast("long").alias("view_id"), "u", "v")
        views = v if views is None else views.unionByName(v)
    m = n.where("y >= 0").select("y", F.posexplode("x").alias("pos", "e")).groupBy("y", "pos").agg(F.avg("e").alias("m"))
    m = m.groupBy(F.col("y").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    return K.reranked(views, n, m)


D2 = """SELECT a.vec_id AS src, b.vec_id AS dst, round(greatest(0, list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) + list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])
- 2 * list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS d2 FROM embeddings a JOIN embeddings b"""


@query("squared_neighbours", f"SELECT src, rank, dst, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM ({D2} ON a.label IS NOT DISTINCT FROM b.label)) WHERE rank <= 8")
def _(spark, sf):
    """Eight nearest by squared distance among the vectors of the same label, each with itself."""
    return V.nearest_squared(V.vectors(spark, sf), 8, batch="y").withColumn("d2", F.round("d2", 6))


@query(
    "random_dilated",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM ({D2} ON TRUE)),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {md5(4, 'src', 'dst')}, dst) AS r FROM r WHERE rank <= 12)
SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM k WHERE r <= 4""",
)
def _(spark, sf):
    """Four of each vector's twelve nearest, in hash order."""
    return V.nearest_squared(V.vectors(spark, sf), 4, 3, seed=4).select("src", "dst", "rank")
