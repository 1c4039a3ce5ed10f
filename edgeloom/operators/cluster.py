"""Clusters of nodes, owners of edges, spanners by clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import adjacency, degree, key, missing, nodes, uniform, with_ends
from edgeloom.operators.metrics import largest_remainder
from edgeloom.operators.paths import nearest_source
from edgeloom.operators.select import uniform_sample
from edgeloom.session import dropped, stored
from edgeloom.sources.files import cached, fingerprint


def bfs_clusters(edges: DataFrame, k: int) -> DataFrame:
    """``(node, cluster)``: nearest of the k nodes of largest degree, the first of equals; unreached nodes by id modulo k."""
    edges = stored(edges.select("u", "v"), "clusters-edges")
    seeds = degree(edges).orderBy(F.col("deg").desc(), "node").limit(k).withColumn("cluster", F.row_number().over(Window.orderBy(F.col("deg").desc(), "node")) - 1)
    seeds = stored(seeds, "clusters-seeds")
    near = nearest_source(edges, seeds).join(F.broadcast(seeds.select(F.col("node").alias("source"), "cluster")), "source").select("node", "cluster")
    return nodes(edges).join(near, "node", "left").select("node", F.coalesce("cluster", F.pmod("node", F.lit(k))).cast("int").alias("cluster"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(node, cluster)``: each round a node takes the commonest label around it, the smallest of equals. Stands in for modularity methods on large graphs."""
    edges = stored(edges.select("u", "v"), "lpa-edges")
    adj = adjacency(edges).withColumnRenamed("src", "node")
    at = nodes(edges).withColumn("cluster", F.col("node"))
    for _ in range(rounds):
        seen = adj.join(at.withColumnsRenamed({"node": "dst"}), "dst").groupBy("node", "cluster").agg(F.count("*").alias("n"))
        at = stored(seen.groupBy("node").agg(F.max_by("cluster", F.struct(F.col("n"), -F.col("cluster"))).alias("cluster")), "lpa")
    return at


def label_clusters(labelled: DataFrame) -> DataFrame:
    """``(node, cluster)``: labels numbered by the smallest node that has them."""
    first = labelled.groupBy("y").agg(F.min("node").alias("first"))
    order = first.withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1)
    return labelled.join(F.broadcast(order), "y").select("node", "cluster")


def hash_clusters(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return nodes(edges).select("node", F.floor(uniform("node", seed=seed) * k).cast("int").alias("cluster"))


def auto_clusters(m: int, large: bool = False) -> int:
    """One cluster per 50,000 edges; 250 for sets known to be large."""
    return 250 if large else max(1, -(-m // 50_000))


def owners(edges: DataFrame, clusters: DataFrame, crossing: str = "lighter") -> DataFrame:
    """Adds ``owner``: inner edges belong to their cluster, crossing ones to the end whose cluster has fewer inner edges (or are dropped)."""
    e = with_ends(edges, clusters, "cluster")
    load = e.where("cluster_u = cluster_v").groupBy(F.col("cluster_u").alias("c")).agg(F.count("*").alias("n"))
    side = lambda s: F.broadcast(load.select(F.col("c").alias(f"cluster_{s}"), F.col("n").alias(f"n_{s}")))
    e = e.join(side("u"), "cluster_u", "left").join(side("v"), "cluster_v", "left").na.fill(0, ["n_u", "n_v"])
    if crossing == "drop":
        e = e.where("cluster_u = cluster_v")
    lighter = F.when((F.col("n_u") < F.col("n_v")) | ((F.col("n_u") == F.col("n_v")) & (F.col("cluster_u") <= F.col("cluster_v"))), F.col("cluster_u")).otherwise(F.col("cluster_v"))
    return e.select(*edges.columns, F.when(F.col("cluster_u") == F.col("cluster_v"), F.col("cluster_u")).otherwise(lighter).alias("owner"))


def cluster_budgets(owned: DataFrame, budget: int) -> DataFrame:
    """``(owner, cap, give)``: a budget dealt to clusters by largest remainder."""
    return largest_remainder(owned.groupBy("owner").agg(F.count("*").alias("cap")), "owner", "cap", budget)


def three_spanner(edges: DataFrame, seed: int = 0, tries: int = 128) -> DataFrame:
    """A subgraph in which every edge's ends are at most 3 hops apart.

    Nodes are centres with chance n^-1/2; a node next to centres joins one by its smallest edge, a node next to none keeps
    all its edges; then each node keeps its smallest edge to every foreign cluster. Tried again until at
    most 2 n^1.5 edges stay, or else the smallest of ``tries`` is taken.
    """
    best = None
    e = stored(edges.select("u", "v", key("u", "v", seed=seed).alias("k")), "spanner-edges")
    n = nodes(e).count()
    adj = adjacency(e.select("u", "v")).select("src", "dst", F.struct(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).alias("e"))
    for t in range(tries):
        centre = nodes(e).where(uniform("node", seed=seed + t) < F.lit(n**-0.5))
        c = centre.select(F.col("node").alias("dst"))
        joined = adj.join(c, "dst").join(centre.select(F.col("node").alias("src")), "src", "left_anti").groupBy("src").agg(F.min("e").alias("e"), F.min_by("dst", "e").alias("cluster"))
        cluster = stored(joined.select(F.col("src").alias("node"), "cluster", "e").unionByName(centre.select("node", F.col("node").alias("cluster"), F.lit(None).cast("struct<u:bigint,v:bigint>").alias("e"))), "spanner-clusters")
        free = adj.join(cluster.select(F.col("node").alias("src")), "src", "left_anti").select("e")
        far = adj.join(cluster.select(F.col("node").alias("src"), F.col("cluster").alias("own")), "src").join(cluster.select(F.col("node").alias("dst"), F.col("cluster").alias("other")), "dst")
        near = far.where("own <> other").groupBy("src", "other").agg(F.min("e").alias("e")).select("e")
        out = stored(cluster.where("e IS NOT NULL").select("e").unionByName(free).unionByName(near).select("e.u", "e.v").distinct(), "spanner")
        m = out.count()
        if m <= 2 * n**1.5:
            return out
        best = min(best or (m, out), (m, out), key=lambda b: b[0])
    return best[1]


def layered_spanner(edges: DataFrame, stretch: int = 3, seed: int = 0) -> DataFrame:
    """``(u, v)``: a subgraph that keeps every distance within ``stretch`` (odd), by clusters that are sampled again and again.

    With k = (stretch + 1) / 2 there are k - 1 rounds: clusters stay with chance n^(-1/k). A node whose cluster goes joins, by its least edge, a
    neighbouring cluster that stays, and keeps its least edge to each cluster that is nearer than that; next to none that stays it keeps
    its least edge to every neighbouring cluster and is done. At the end each node keeps its least edge to every neighbouring
    cluster. Edges are in order of ``w`` (if there is one), then of a hash. Tables of a round are deleted when the next has its own.
    """
    k = max(1, (int(stretch) + 1) // 2)
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = stored(edges.select("u", "v", F.struct(w.alias("w"), F.unhex(key("u", "v", seed=seed)).alias("h"), "u", "v").alias("o")), "spanner-edges")
    own = stored(nodes(e).withColumn("c", F.col("node")), "spanner-clusters")
    n = own.count()
    both = lambda e: e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "o").unionAll(e.select("v", "u", "o"))
    near = lambda e: (  # the least edge of each node to each neighbouring cluster
        both(e).join(own.toDF("src", "cs"), "src").join(own.toDF("dst", "cd"), "dst").where("cs <> cd").groupBy("src", "cs", "cd").agg(F.min("o").alias("o"))
    )
    kept = []
    for i in range(k - 1):
        stays = lambda c: uniform(c, seed=seed + 7919 * (i + 1)) < F.lit(float(n) ** (-1.0 / k))  # noqa: B023, E731
        around = stored(near(e).where(~stays("cs")), "spanner-near")
        to = around.where(stays("cd")).groupBy("src").agg(F.min("o").alias("best"), F.min_by("cd", "o").alias("to"))
        a = stored(around.join(to, "src", "left").where(F.col("best").isNull() | (F.col("o") <= F.col("best"))).select("src", "cd", "to", F.col("o.u").alias("u"), F.col("o.v").alias("v")), "spanner-kept")
        dropped(around)
        kept.append(stored(a.select("u", "v").distinct(), "spanner-round"))
        # what goes: edges of a node to the clusters it has kept an edge to, and all edges within a cluster
        left = stored(own.where(stays("c")).unionByName(a.where("cd = to").select(F.col("src").alias("node"), F.col("to").alias("c"))), "spanner-clusters")
        gone = both(e).join(own.toDF("dst", "cd"), "dst").join(a.select("src", "cd"), ["src", "cd"], "left_semi").select("o.u", "o.v")
        rest = e.join(gone.distinct(), ["u", "v"], "left_anti")
        rest = rest.join(left.toDF("u", "cu"), "u").join(left.toDF("v", "cv"), "v").where("cu <> cv").select("u", "v", "o")
        rest = stored(rest, "spanner-edges")
        dropped(a, own, e)
        own, e = left, rest
    out = near(e).select("o.u", "o.v")
    for new in kept:
        out = out.unionByName(new)
    out = stored(out.distinct(), "spanner")
    dropped(own, e, *kept)
    return out


#: The stretches that are tried.
STRETCHES = (3, 5, 7, 9, 11)


def adaptive_spanner(edges: DataFrame, q: int, start: int = 3, seed: int = 0) -> tuple[int, DataFrame]:
    """The stretch whose spanner has a size nearest to q, and the spanner.

    From ``start`` the stretches go up while spanners are above q, or down while they are below; of what was tried the nearest size is taken,
    of equally near ones one that is not below q, then the smaller stretch.
    """
    tried: dict[int, tuple[int, DataFrame]] = {}

    def size(at: int) -> int:
        t = STRETCHES[at]
        if t not in tried:
            s = layered_spanner(edges, t, seed)
            tried[t] = s.count(), s
        return tried[t][0]

    at = STRETCHES.index(start)
    step = 1 if size(at) > q else -1
    while 0 <= at + step < len(STRETCHES) and (size(at) > q if step > 0 else size(at) < q):
        at += step
        size(at)
    best = min(tried, key=lambda t: (abs(tried[t][0] - q), tried[t][0] < q, t))
    dropped(*(s for t, (_, s) in tried.items() if t != best))
    return best, tried[best][1]


def tuned_spanner(edges: DataFrame, q: int, start: int = 3, seed: int = 0, name: str = "", root: str | None = None) -> tuple[int, DataFrame]:
    """As ``adaptive_spanner``, but the stretch that was chosen is kept under the graph's fingerprint, size and seed, so later runs build one spanner only."""
    e = stored(edges, "tuned-edges")
    made = []

    def build() -> DataFrame:
        made.append(adaptive_spanner(e, q, start, seed))
        return e.sparkSession.createDataFrame([(made[0][0],)], "stretch int")

    record = cached(e.sparkSession, {"spanner": name, "graph": fingerprint(e), "q": q, "start": start, "seed": seed}, build, root)
    stretch = record.first()["stretch"]
    return stretch, made[0][1] if made else layered_spanner(e, stretch, seed)


def spanner_to_budget(edges: DataFrame, spanner: DataFrame, q: int, seed: int = 0) -> DataFrame:
    """A spanner cut or filled to exactly q edges in hash order."""
    n = spanner.count()
    if n >= q:
        return uniform_sample(spanner, q, seed)
    return spanner.unionByName(uniform_sample(missing(edges, spanner).select("u", "v"), q - n, seed))


def fast_by_cluster(owned: DataFrame, budget: int, scored: DataFrame) -> DataFrame:
    """The best scores of each owner within its part of a budget; ``scored`` has (u, v, s)."""
    give = cluster_budgets(owned, budget).select("owner", "give")
    w = Window.partitionBy("owner").orderBy(F.col("s").desc(), "u", "v")
    e = owned.select("u", "v", "owner").join(scored, ["u", "v"]).withColumn("__r", F.row_number().over(w))
    return e.join(F.broadcast(give), "owner").where("__r <= give").select("u", "v")


