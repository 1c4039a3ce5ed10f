"""Graph families with known structure, from ranges and arithmetic; seeded ones draw by hash.

A spec is ``synth-<family><size>-s<seed>``; size and seed may be left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import key, uniform


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return df.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where("u <> v").distinct()


def grid(spark: SparkSession, k: int = 16, seed: int = 0, wrap: bool = False) -> DataFrame:
    """k x k lattice; ``wrap`` makes it a torus."""
    n = spark.range(k * k).select("id", F.floor(F.col("id") / k).alias("r"), (F.col("id") % k).alias("c"))
    n = n.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    r, c = F.when(F.col("s") == 0, F.col("r") + 1).otherwise(F.col("r")), F.when(F.col("s") == 1, F.col("c") + 1).otherwise(F.col("c"))
    if wrap:
        return _pairs(n, F.col("id"), (r % k) * k + c % k)
    return _pairs(n.withColumn("r2", r).withColumn("c2", c).where(f"r2 < {k} AND c2 < {k}"), F.col("id"), F.col("r2") * k + F.col("c2"))


def theta(spark: SparkSession, k: int = 14, seed: int = 0, length: int = 3) -> DataFrame:
    """k disjoint paths between nodes 0 and 1."""
    n = spark.range(k * length).select(F.floor(F.col("id") / length).alias("i"), (F.col("id") % length).alias("j"))
    inner = lambda j: 2 + F.col("i") * (length - 1) + j
    a = F.when(F.col("j") == 0, F.lit(0)).otherwise(inner(F.col("j") - 1))
    b = F.when(F.col("j") == length - 1, F.lit(1)).otherwise(inner(F.col("j")))
    return _pairs(n, a, b)


def _cliques(spark: SparkSession, cliques: int, size: int) -> DataFrame:
    n = spark.range(cliques * size * size)
    base = F.floor(F.col("id") / (size * size)) * size
    return _pairs(n, base + F.floor(F.col("id") % (size * size) / size), base + F.col("id") % size)


def barbell(spark: SparkSession, clique: int = 20, seed: int = 0, length: int = 6) -> DataFrame:
    """Two cliques joined by a path of ``length`` nodes: the second clique's ids come after the path's."""
    two = _cliques(spark, 2, clique)
    shift = lambda c: F.when(F.col(c) >= clique, F.col(c) + length).otherwise(F.col(c))
    path = spark.range(clique - 1, clique + length)
    return _pairs(two, shift("u"), shift("v")).unionByName(_pairs(path, F.col("id"), F.col("id") + 1))


def ring_of_cliques(spark: SparkSession, cliques: int = 8, seed: int = 0, clique: int = 5) -> DataFrame:
    """Cliques in a ring, neighbours joined by one edge."""
    ring = spark.range(cliques)
    return _cliques(spark, cliques, clique).unionByName(_pairs(ring, F.col("id") * clique + 1, (F.col("id") + 1) % cliques * clique)).distinct()


def spider(spark: SparkSession, corridors: int = 12, seed: int = 0, length: int = 6) -> DataFrame:
    """Disjoint paths and node 0, which neighbours all their nodes."""
    n = spark.range(1, corridors * length + 1)
    along = n.where((F.col("id") - 1) % length < length - 1)
    return _pairs(n, F.lit(0), F.col("id")).unionByName(_pairs(along, F.col("id"), F.col("id") + 1))


def block_model(spark: SparkSession, blocks: int = 8, seed: int = 0, size: int = 25, inside: float = 0.5, outside: float = 0.004) -> DataFrame:
    """Dense blocks and sparse cuts, all of it, not the largest component only."""
    n = blocks * size
    p = spark.range(n * n).select(F.floor(F.col("id") / n).alias("u"), (F.col("id") % n).alias("v")).where("u < v")
    same = F.floor(F.col("u") / size) == F.floor(F.col("v") / size)
    return p.where(uniform("u", "v", seed=seed) < F.when(same, F.lit(inside)).otherwise(F.lit(outside))).select(F.col("u").cast("long"), F.col("v").cast("long"))


def bottleneck(spark: SparkSession, width: int = 4, seed: int = 0, blob: int = 50, deg: int = 10, corridor: int = 3) -> DataFrame:
    """Two circulant blobs of one degree (in place of random regular ones), relabelled by hash, joined by ``width`` corridors."""
    if not 1 <= width <= deg:
        raise ValueError("the width must be between 1 and the degree of a blob's nodes")
    w = Window.partitionBy("side").orderBy(key("id", seed=seed), "id")
    place = spark.range(2 * blob).select("id", F.floor(F.col("id") / blob).alias("side")).withColumn("p", F.row_number().over(w) - 1)
    a, b = place.select("side", F.col("p").alias("p"), F.col("id").alias("a")), place.select("side", F.col("p").alias("q"), F.col("id").alias("b"))
    blobs = a.withColumn("q", F.explode(F.array(*[(F.col("p") + i) % blob for i in range(1, deg // 2 + 1)]))).join(b, ["side", "q"])
    ends = place.where(F.col("p") % (blob // width) == 0).where(F.floor(F.col("p") / (blob // width)) < width).select("side", F.floor(F.col("p") / (blob // width)).alias("i"), "id")
    e = ends.where("side = 0").select("i", F.col("id").alias("x")).join(ends.where("side = 1").select("i", F.col("id").alias("y")), "i")
    e = e.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(corridor)])))
    inner = lambda j: 2 * blob + F.col("i") * (corridor - 1) + j
    path = _pairs(e, F.when(F.col("j") == 0, F.col("x")).otherwise(inner(F.col("j") - 1)), F.when(F.col("j") == corridor - 1, F.col("y")).otherwise(inner(F.col("j"))))
    return _pairs(blobs, F.col("a"), F.col("b")).unionByName(path)


def hub_ring(spark: SparkSession, chords: int = 60, seed: int = 0, ring: int = 120, stride: int = 4) -> DataFrame:
    """A ring with hashed long chords, and a hub that neighbours every ``stride``-th node."""
    far = max(2, ring // 4)
    p = spark.range(ring * ring).select(F.floor(F.col("id") / ring).cast("long").alias("u"), (F.col("id") % ring).alias("v")).where("u < v")
    gap = F.col("v") - F.col("u")
    long = p.where(F.least(gap, ring - gap) >= far).orderBy(key("u", "v", seed=seed), "u", "v").limit(chords)
    n = spark.range(ring)
    return _pairs(n, F.col("id"), (F.col("id") + 1) % ring).unionByName(_pairs(n.where(F.col("id") % stride == 0), F.lit(ring), F.col("id"))).unionByName(long)


# Family names, their aliases, and the sizes they have by default.
FAMILIES = {
    "grid": (grid, 16),
    "torus": (lambda s, k, seed: grid(s, k, seed, True), 16),
    "theta": (theta, 14),
    "bneck": (bottleneck, 4),
    "sbm": (block_model, 8),
    "barbell": (barbell, 20),
    "ringclique": (ring_of_cliques, 8),
    "spider": (spider, 12),
    "hubring": (hub_ring, 60),
    "hubblock": (lambda s, k, seed: ring_of_cliques(s, 6, seed, k), 16),
}
ALIASES = {"lattice": "grid", "bottleneck": "bneck", "tree_cycle": "ringclique", "ring_of_cliques": "ringclique", "corridor_hub": "spider", "ringhub": "hubring", "starblock": "hubblock", "ring_of_big_cliques": "hubblock"}


def parse_spec(spec: str) -> tuple[str, int, int]:
    """(family, size, seed) of a spec; an unknown family is an error."""
    m = re.fullmatch(r"(?:synth-)?([a-z_]+?)(\d*)(?:-s(\d+))?", spec)
    name = ALIASES.get(m[1], m[1]) if m else None
    if name not in FAMILIES:
        raise ValueError(f"no graph family in {spec!r}")
    return name, int(m[2] or FAMILIES[name][1]), int(m[3] or 0)


def build(spark: SparkSession, spec: str) -> DataFrame:
    """Canonical edges of a spec."""
    name, size, seed = parse_spec(spec)
    return FAMILIES[name][0](spark, size, seed)
