"""The registry of selectors: name to ``(edges, ratio, seed, **options) -> (u, v[, weight])``.

Own selectors are added with ``register``. A selector gets canonical ``edges`` (u, v, w) and, where it reads features,
``features=`` a table of (node, x).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.functions import scoring as S
from edgeloom.operators import cluster as U
from edgeloom.operators import combine as K
from edgeloom.operators import edges as E
from edgeloom.operators import forest as T
from edgeloom.operators import growth as G
from edgeloom.operators import masks as M
from edgeloom.operators import select as C
from edgeloom.operators import sequential as Q
from edgeloom.operators import spectral as Z
from edgeloom.operators import tickets as H
from edgeloom.operators.order import top

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(*names: str):
    def put(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return put


# Other names of forests.
ALIASES = {
    "minst": "mst",
    "fast_minst": "fast_mst",
    "maxsf": "maxst",
    "msf": "mst",
    "minsf": "mst",
    "fast_maxsf": "fast_maxst",
    "fast_msf": "fast_mst",
    "fast_minsf": "fast_mst",
    "randsf": "randst",
    "fast_randsf": "fast_randst",
    "slsf": "slst",
    "glsf": "glst",
    "llsf": "llst",
    "randspf": "randspt",
    "sf": "maxst",
    "st": "maxst",
}


def canonical_name(name: str) -> str:
    """A selector's name in lower case with underscores, and without its aliases."""
    n = name.strip().lower().replace("-", "_")
    return ALIASES.get(n, n)


def selector(name: str) -> Callable[..., DataFrame]:
    """By name, in any case and with dashes or underscores, or by an alias."""
    n = canonical_name(name)
    if n not in REGISTRY:
        raise KeyError(f"no selector {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[n]


def _round(edges, ratio):
    return E.budget(edges.count(), ratio, "round")


def _by(score: str, digits: int = 9):
    return lambda scored, edges, ratio: C.top_k(scored, F.round(score, digits), _round(edges, ratio)).select("u", "v")


@register("full")
def _(edges, ratio=1.0, seed=0, **_):
    return edges.select("u", "v")


@register("random", "random_refresh")
def _(edges, ratio=0.3, seed=0, **_):
    return C.uniform_sample(edges, _round(edges, ratio), seed).select("u", "v")


@register("mst", "spanning_forest")
def _(edges, ratio=None, seed=0, **_):
    return T.spanning_forest(edges, [F.col("w")] if "w" in edges.columns else []).select("u", "v")


@register("maxst")
def _(edges, ratio=None, seed=0, **_):
    f = T.spanning_forest(edges, [F.col("w").desc()])
    return (f if ratio is None else top(f, [F.col("rank")], E.budget(edges.count(), ratio))).select("u", "v")


@register("fast_maxst")
def _(edges, ratio=None, seed=0, features=None, buckets=256, kind="cosine", **_):
    e = S.feature_weight(edges, features, kind if features is not None else "uniform")
    ends = F.broadcast(e.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")))
    e = e.crossJoin(ends).withColumn("b", S.bucket(F.col("weight"), F.col("lo"), F.col("hi"), buckets, True))
    return T.spanning_forest(e, [F.col("b")]).select("u", "v")


@register("fast_mst")
def _(edges, ratio=None, seed=0, features=None, buckets=256, kind="cosine", **_):
    e = S.feature_weight(edges, features, kind if features is not None else "uniform")
    ends = F.broadcast(e.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")))
    e = e.crossJoin(ends).withColumn("b", S.bucket(F.col("weight"), F.col("lo"), F.col("hi"), buckets))
    return T.spanning_forest(e, [F.col("b")]).select("u", "v")


@register("randst", "fast_randst")
def _(edges, ratio=None, seed=0, **_):
    return T.random_forest(edges, seed).select("u", "v")


@register("gspar")
def _(edges, ratio=0.3, seed=0, **_):
    return _by("jaccard")(S.neighbourhood(edges), edges, ratio)


@register("lspar")
def _(edges, ratio=None, seed=0, e=0.6, **_):
    n = S.neighbourhood(edges).withColumn("s", F.round("jaccard", 9))
    if ratio is not None:  # with a ratio the same as gspar
        return _by("jaccard")(n, edges, ratio)
    a = n.select(F.col("u").alias("src"), F.col("v").alias("dst"), "s", F.col("deg_u").alias("d")).unionAll(n.select("v", "u", "s", "deg_v"))
    kept = C.per_node(a, F.col("s"), F.greatest(F.lit(1), F.floor(F.pow("d", F.lit(e)))))
    return kept.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


@register("lsim")
def _(edges, ratio=0.3, seed=0, **_):
    return _by("lsim", 6)(S.local_similarity(edges), edges, ratio)


@register("scan")
def _(edges, ratio=0.3, seed=0, **_):
    return _by("scan")(S.neighbourhood(edges), edges, ratio)


@register("local_degree")
def _(edges, ratio=0.3, seed=0, **_):
    return _by("local_degree", 6)(S.local_degree(edges), edges, ratio)


@register("rank_degree")
def _(edges, ratio=0.3, seed=0, rho=0.1, **_):
    return Q.rank_degree(edges, ratio, rho, seed=seed)


@register("forest_fire")
def _(edges, ratio=0.3, seed=0, burn=None, **_):
    return Q.forest_fire(edges, ratio, burn, seed=seed)


@register("k_random_neighbor")
def _(edges, ratio=None, seed=0, k=5, **_):
    return C.random_neighbours(E.adjacency(edges), k, seed)


@register("cut")
def _(edges, ratio=None, seed=0, epsilon=10.0, d=1, connectivity=10, **_):
    import math

    n = E.nodes(edges).count()
    return C.bernoulli(edges, min(1.0, 16 * (d + 2) * math.log(max(n, 2)) / (epsilon**2 * connectivity)), seed).select("u", "v")


def _leverage(edges, exact, most_nodes=5000):
    """``p`` of each edge: its share of the leverages. ``exact=None`` takes the exact resistances up to ``most_nodes`` nodes, the sketch over edge tables beyond."""
    if exact is None:
        exact = E.nodes(edges).count() <= most_nodes
    r = (Q.resistance if exact else Z.sketched_resistances)(edges).join(edges, ["u", "v"])
    r = r.withColumn("leverage", S.sanitised(F.col("resistance") * F.col("w")))
    return r.crossJoin(F.broadcast(r.agg(F.sum("leverage").alias("__t")))).withColumn("p", F.col("leverage") / F.col("__t")).select("u", "v", "w", "p")


@register("effective_resistance", "er_spectral", "er")
def _(edges, ratio=0.3, seed=0, exact=None, **_):
    p, q = _leverage(edges, exact), E.budget(edges.count(), ratio)
    d = C.with_replacement(p, "p", q, [F.col("u"), F.col("v")], seed)
    return d.select("u", "v", (F.col("n") * F.col("w") / (q * F.col("p"))).alias("weight"))


@register("effective_resistance_fixed", "er_fix")
def _(edges, ratio=0.3, seed=0, exact=None, **_):
    """Drawn with replacement until there are exactly as many distinct edges as the ratio asks for."""
    p, q = _leverage(edges, exact), E.budget(edges.count(), ratio)
    d, draws = C.until_distinct(p, "p", q, [F.col("u"), F.col("v")], seed)
    return d.select("u", "v", (F.col("n") * F.col("w") / (draws * F.col("p"))).alias("weight"))


@register("tspanner_greedy")
def _(edges, ratio=None, seed=0, stretch=3, group=None, **_):
    return Q.greedy_spanner(edges, stretch, seed, group)


@register("tspanner_halperin")
def _(edges, ratio=None, seed=0, stretch=3, **_):
    return U.layered_spanner(edges, stretch, seed)


@register("adaptive_spanner")
def _(edges, ratio=0.3, seed=0, stretch=3, **_):
    q = E.budget(edges.count(), ratio, "round")
    return U.spanner_to_budget(edges, U.adaptive_spanner(edges, q, stretch, seed)[1], q, seed)


@register("las_vegas_spanner")
def _(edges, ratio=0.3, seed=0, **_):
    return U.spanner_to_budget(edges, U.three_spanner(edges, seed), E.budget(edges.count(), ratio, "round"), seed)


@register("slst", "scalable_low_stretch_tree", "fast_low_stretch_tree")
def _(edges, ratio=None, seed=0, roots=8, group=None, **_):
    return Q.low_stretch_tree(edges, roots, group)


@register("glst", "low_stretch_tree")
def _(edges, ratio=None, seed=0, alpha=1.0, eta=1.0, group=None, **_):
    return G.greedy_low_stretch(edges, alpha, eta, group)


@register("llst", "local_search_low_stretch_tree")
def _(edges, ratio=None, seed=0, passes=10, group=None, **_):
    return G.local_low_stretch(edges, passes, group=group)


@register("randspt", "random_shortest_path_tree")
def _(edges, ratio=None, seed=0, weight=None, **_):
    return G.random_shortest_forest(edges, seed, weight)


@register("random_spanning_tree")
def _(edges, ratio=None, seed=0, group=None, **_):
    return Q.uniform_tree(edges, seed, group)


@register("support", "support_cpp")
def _(edges, ratio=0.4, seed=0, by="node", group=None, **_):
    return Q.congested_growth(edges, ratio, by, seed, group)


@register("support_dilation")
def _(edges, ratio=0.4, seed=0, group=None, **_):
    return Q.congested_growth(edges, ratio, "dilation", seed, group)


def _options(o, *names):
    return {k: v for k, v in o.items() if k in names}


@register("support_batch")
def _(edges, ratio=0.4, seed=0, add=64, sample=512, **o):
    """Rounds that score a hashed sample of the missing edges of each group and add the best of it."""
    return Q.greedy_support(edges, ratio, add, sample, seed=seed, **_options(o, "alpha", "beta_e", "beta_v", "p", "q", "group"))


@register("joint_dilation_congestion")
def _(edges, ratio=0.4, seed=0, add=1, **o):
    """All missing edges are scored anew in each round."""
    return Q.greedy_support(edges, ratio, add, None, seed=seed, **_options(o, "alpha", "beta_e", "beta_v", "p", "q", "group"))


def _clustered(edges, group, clusters, seed):
    """Edges with the column of their group: a given one, or the owner of each edge among hashed clusters of nodes."""
    if group:
        return edges, group
    k = clusters or U.auto_clusters(edges.count())
    return U.owners(edges, U.hash_clusters(edges, k, seed)), "owner"


@register("clustered_joint_dilation_congestion", "parallel_clustered_joint_dilation_congestion")
def _(edges, ratio=0.4, seed=0, radius=1, group=None, clusters=None, **o):
    """A heap for each cluster, whose entries near an added edge are scored anew when they come up."""
    e, g = _clustered(edges, group, clusters, seed)
    return G.lazy_growth(e, ratio, "joint", radius=radius, seed=seed, group=g, **_options(o, "alpha", "beta_e", "beta_v", "add"))


@register("support_heap")
def _(edges, ratio=0.4, seed=0, radius=1, group=None, clusters=None, **o):
    """As the clustered growth, with logarithms of the largest congestions as the score."""
    e, g = _clustered(edges, group, clusters, seed)
    return G.lazy_growth(e, ratio, "log", radius=radius, seed=seed, group=g, **_options(o, "beta_e", "beta_v", "add"))


@register("support_greedy", "support_exact")
def _(edges, ratio=0.4, seed=0, **o):
    return Q.greedy_support(edges, ratio, 1, None, seed=seed, **{k: v for k, v in o.items() if k in ("alpha", "beta_e", "beta_v", "p", "q", "group")})


@register("support_fast")
def _(edges, ratio=0.3, seed=0, **o):
    return K.fast_support(edges, E.budget(edges.count(), ratio), [F.col("w").desc()], **o)


@register("support_sample")
def _(edges, ratio=0.3, seed=0, forests=8, lam=1.0, offset=0.5, **_):
    return K.sample_support(edges, K.sample_weights(edges, forests, lam, seed), E.budget(edges.count(), ratio), offset, seed)


@register("dspar")
def _(edges, ratio=0.3, seed=0, **_):
    q = E.budget(edges.count(), ratio, "floor")
    kept = C.race(S.degree_probability(edges), F.col("p"), q, seed)
    return kept.select("u", "v", (1 / F.least(F.lit(1.0), q * F.col("p"))).alias("weight"))


@register("unified_lth")
def _(edges, ratio=0.3, seed=0, score="w", rate=0.05, scoring=H.by_degree, duals=0, **_):
    """Rounds that drop ``rate`` of what is left by scores of what is left, down to the ratio; with ``duals`` above 0, that many rounds of alternating directions instead."""
    q = E.budget(edges.count(), ratio)
    return H.admm(edges, q, rounds=duals, weight=score) if duals else H.lottery(edges, q, rate, scoring, score)


@register("adaglt")
def _(edges, ratio=0.3, seed=0, scores=None, thresholds=None, **_):
    """Given scores of layers, a table of (layer, u, v, s): masks that only shrink from layer to layer, down to the ratio; the last layer's is returned.

    With ``thresholds`` (layer, node, t) scores are held against those of their first nodes. Without scores the weights are those of one layer.
    """
    m = edges.count()
    if scores is None:
        scores = edges.select(F.lit(0).alias("layer"), "u", "v", F.col("w").alias("s"))
    layers = scores.agg(F.max("layer")).first()[0] + 1
    budgets = [E.budget(m, 1 - (1 - ratio) * (i + 1) / layers) for i in range(layers)]
    masks = C.shrinking_masks(scores, budgets) if thresholds is None else M.layered_masks(scores, thresholds, budgets)
    return masks.where(F.col("layer") == layers - 1).select("u", "v")


@register("prune_adj")
def _(edges, ratio=0.3, seed=0, **_):
    return C.percentile_pruned(edges, 100 * (1 - ratio)).select("u", "v")


@register("mog")
def _(edges, ratio=0.3, seed=0, score="w", scores=None, gates=None, ratios=(0.5,), **_):
    """Given experts' scores (src, dst, experts) and gates (node, gates): their mixture; else one edge a node, then the best of the rest."""
    if scores is not None:
        return M.expert_mixture(scores, gates, list(ratios), E.budget(edges.count(), ratio), seed=seed).select("u", "v")
    a = E.adjacency(edges.withColumn("w", F.col(score)))
    kept = C.one_each(a, F.col("w"), 2 * E.budget(edges.count(), ratio))
    return kept.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


@register("ticket")
def _(edges, ratio=0.3, seed=0, **_):
    return C.ticket(edges.select("u", "v"), E.budget(edges.count(), ratio), seed)


@register("fixed_support")
def _(edges, ratio=None, seed=0, support=None, **_):
    """A stored support, checked against the graph."""
    c = E.checked(support, edges).first()
    if c["n"] != c["pairs"] or c["not_canonical"] or c["foreign_edges"] or c["bad_weights"]:
        raise ValueError(f"not a support of this graph: {c.asDict()}")
    return support


@register("support_sequence")
def _(edges, ratio=None, seed=0, supports=None, base=0, **_):
    """The view that is ``(seed - base)`` modulo their number, of a table with view_id."""
    n = supports.select("view_id").distinct().count()
    return supports.where(F.col("view_id") == (seed - base) % n).select("u", "v")
