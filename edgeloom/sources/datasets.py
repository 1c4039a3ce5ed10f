"""Graphs by name: builders over tables, folders and archives below a root, and the split protocols.

A dataset is a folder ``<root>/<name>`` with tables ``nodes`` (node[, x][, y]), ``edges`` (src, dst or u, v) and perhaps ``splits``
(split_id, node, part), or an archive ``<root>/<name>.npz``, or what a registered builder returns. Nothing is downloaded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from edgeloom.operators.metrics import balanced_split, class_split
from edgeloom.sources.archive import cached_split, finalised, fixed_splits
from edgeloom.sources.files import read_npz

# Names, other names for them, and protocols.
NAMES = """amazon-computer amazon-photo amazon-ratings chameleon citeseer coauthor-cs coauthor-physics cora cora-full cornell karate karate-balance
minesweeper ogbn-arxiv ogbn-products ogbn-proteins pokec pubmed reddit reddit2 roman-empire squirrel texas tolokers questions wikics wisconsin reed98
amherst41 penn94 johnshopkins55 cornell5""".split()
ALIASES = {
    "amazon-computers": "amazon-computer", "arxiv": "ogbn-arxiv", "corafull": "cora-full", "karate-balanced": "karate-balance", "karateclub": "karate",
    "ogb-arxiv": "ogbn-arxiv", "ogb-product": "ogbn-products", "ogb-products": "ogbn-products", "ogb-protein": "ogbn-proteins", "ogb-proteins": "ogbn-proteins",
    "product": "ogbn-products", "products": "ogbn-products", "protein": "ogbn-proteins", "proteins": "ogbn-proteins", "pokec-regions": "pokec",
    "graphland-pokec": "pokec", "amherest41": "amherst41", "johnhopkings55": "johnshopkins55",
}
PROTOCOLS = ("tunedgnn", "native", "random")
#: Names that the first protocol splits by class: nodes a class for training, and for validation.
BY_CLASS = {"cora": (20, 500), "citeseer": (20, 500), "pubmed": (20, 500)}

BUILDERS: dict[str, Callable] = {}


@dataclass(frozen=True)
class Dataset:
    """A graph with its labels and splits; ``y`` is a whole number, -1 for none, or an array of flags."""

    name: str
    nodes: DataFrame
    edges: DataFrame
    splits: DataFrame
    classes: int
    multilabel: bool
    protocol: str


def canonical_name(name: str) -> str:
    """A dataset's own name, from any way to write it."""
    n = name.strip().lower().replace("_", "-").replace(" ", "-")
    return ALIASES.get(n, n)


def register(name: str, build: Callable) -> None:
    """Give a name to a function of the session that returns tables of nodes and edges, and splits or None."""
    BUILDERS[canonical_name(name)] = build


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _tables(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    if name in BUILDERS:
        return BUILDERS[name](spark)
    if _there(spark, f"{root}/{name}/edges"):
        read = lambda t: spark.read.parquet(f"{root}/{name}/{t}")
        return read("nodes"), read("edges"), read("splits") if _there(spark, f"{root}/{name}/splits") else None
    if _there(spark, f"{root}/{name}.npz"):
        t = read_npz(spark, f"{root}/{name}.npz")
        return t["nodes"], t["edges"], t["splits"] if t["splits"].limit(1).count() else None
    raise FileNotFoundError(f"dataset {name}: neither {root}/{name}/edges nor {root}/{name}.npz is there")


def load_dataset(spark: SparkSession, root: str, name: str, seed: int = 42, train_ratio: float = 0.5, valid_ratio: float = 0.25, split_protocol: str = "tunedgnn") -> Dataset:
    """A dataset with canonical edges, features for every node and splits by a protocol.

    ``random`` splits anew and keeps the split below ``<root>/splits``; ``native`` takes the splits that come with the data;
    ``tunedgnn`` prefers ``<root>/<name>_split.npz``, then the class rule of its name. Where there are none, the split is random.
    Splits need all of train, valid and test, and no node twice in a split.
    """
    name, split_protocol, root = canonical_name(name), str(split_protocol).lower(), root.rstrip("/")
    if split_protocol not in PROTOCOLS:
        raise ValueError(f"split_protocol must be one of {', '.join(PROTOCOLS)}")
    if name not in NAMES and name not in BUILDERS:
        raise ValueError(f"unknown dataset {name}; known are {', '.join([*NAMES, *BUILDERS])}")
    if not 0 < train_ratio < 1 or not 0 < valid_ratio < 1 - train_ratio:
        raise ValueError("ratios must be above 0 and leave a part for the test")
    nodes, pairs, given = _tables(spark, root, name)
    a, b = ("u", "v") if "u" in pairs.columns else ("src", "dst")
    edges = pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    multilabel = "y" in nodes.columns and isinstance(nodes.schema["y"].dataType, ArrayType)
    if multilabel:
        plain = finalised(nodes.drop("y"), edges).drop("y")
        nodes = plain.join(nodes.select("node", F.col("y").cast("array<double>").alias("y")), "node")
        classes = nodes.agg(F.max(F.size("y"))).first()[0] or 0
    else:
        nodes = finalised(nodes, edges)
        classes = int(nodes.agg(F.coalesce(F.max("y"), F.lit(-1))).first()[0]) + 1
    splits = None if split_protocol == "random" else given
    if split_protocol == "tunedgnn" and _there(spark, f"{root}/{name}_split.npz"):
        splits = fixed_splits(spark, f"{root}/{name}_split.npz")
    elif split_protocol == "tunedgnn" and not multilabel and name in BY_CLASS:
        splits = class_split(nodes, *BY_CLASS[name], seed).withColumn("split_id", F.lit(0))
    elif split_protocol == "tunedgnn" and not multilabel and name == "karate-balance":
        each = max(1, nodes.where("y >= 0").count() // (4 * max(1, classes)))
        splits = balanced_split(nodes, each, each * classes, seed).withColumn("split_id", F.lit(0))
    if splits is None:
        labelled = nodes.select("node") if multilabel else nodes.select("node", "y")
        splits = cached_split(labelled, name, seed, train_ratio, valid_ratio, f"{root}/splits").withColumn("split_id", F.lit(0))
    splits = splits.select(F.col("split_id").cast("int").alias("split_id"), "node", "part")
    wrong = splits.where(~F.col("part").isin("train", "valid", "test") | F.col("part").isNull()).limit(1).count()
    if wrong or splits.groupBy("split_id", "node").count().where("count > 1").limit(1).count():
        raise ValueError(f"splits of {name}: an unknown part, or a node twice in a split")
    return Dataset(name, nodes, edges, splits, int(classes), multilabel, split_protocol)
