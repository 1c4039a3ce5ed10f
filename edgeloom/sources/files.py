"""Readers and writers: array archives, MATLAB files, typed CSV, keyed upserts, checked artifacts, result caches."""

from __future__ import annotations

import hashlib
import io
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import shared_dir


def read_npz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an array archive with ``edges`` (2 x E or E x 2), ``node_features``, ``node_labels`` and ``*_masks``.

    The file is read through Spark, so any store it knows will do.
    """
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    e = a["edges"]
    e = e if e.shape[0] == 2 and e.shape[1] != 2 else e.T
    out = {"edges": spark.createDataFrame(pa.table({"src": e[0].astype(np.int64), "dst": e[1].astype(np.int64)}))}
    n = len(a["node_labels"])
    x = a["node_features"] if "node_features" in a else np.zeros((n, 0))
    out["nodes"] = spark.createDataFrame(pa.table({"node": np.arange(n), "x": [list(map(float, r)) for r in x], "y": a["node_labels"].astype(np.int64)}))
    parts = {"train_masks": "train", "val_masks": "valid", "test_masks": "test"}
    rows = [(i, int(v), part) for k, part in parts.items() if k in a for i, m in enumerate(np.atleast_2d(a[k])) for v in np.flatnonzero(m)]
    out["splits"] = spark.createDataFrame(rows, "split_id int, node long, part string")
    return out


def read_mat(spark: SparkSession, path: str, adjacency: str = "A") -> DataFrame:
    """Directed pairs of a sparse matrix in a MATLAB file; needs SciPy, and says so."""
    try:
        from scipy.io import loadmat
    except ModuleNotFoundError as missing:
        raise ModuleNotFoundError("MATLAB files need the package scipy", name=missing.name) from missing

    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    m = loadmat(io.BytesIO(raw))[adjacency].tocoo()
    return spark.createDataFrame(pa.table({"src": m.row.astype(np.int64), "dst": m.col.astype(np.int64)}))


def encode_columns(df: DataFrame, numeric: list[str] = (), fractions: list[str] = (), categorical: list[str] = (), scaler: str = "standard") -> DataFrame:
    """``x`` from typed columns: numbers with the commonest value for missing ones, then scaled; fractions filled only;
    categories one-hot in order, two of them as one column. Scalers: ``standard``, ``minmax``, ``uniform`` (rank quantile), ``normal``."""
    from edgeloom.operators.order import average_percentile

    parts = []
    for c in [*numeric, *fractions]:
        mode = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).limit(1).collect()
        df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(mode[0][0]) if mode else 0.0)))
    for c in numeric:
        if scaler in ("uniform", "normal"):
            df = average_percentile(df, c, f"__{c}")
            if scaler == "normal":
                p = F.least(F.greatest(f"__{c}", F.lit(1e-7)), F.lit(1 - 1e-7))
                df = df.withColumn(f"__{c}", _inverse_normal(p))
        else:
            s = df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("d"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
            shift, width = (s["m"], s["d"]) if scaler == "standard" else (s["lo"], (s["hi"] or 0) - (s["lo"] or 0))
            df = df.withColumn(f"__{c}", (F.col(c) - F.lit(shift)) / F.lit(width or 1.0))
        parts.append(F.col(f"__{c}"))
    parts += [F.col(c) for c in fractions]
    for c in categorical:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]
        parts += [(F.coalesce(F.col(c) == v, F.lit(False))).cast("double") for v in (values[1:] if len(values) == 2 else values)]
    return df.withColumn("x", F.array(*parts)).drop(*[f"__{c}" for c in numeric])


def _inverse_normal(p):
    """Quantiles of the normal distribution, by a rational approximation of its tails (error below 5e-4)."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -z).otherwise(z)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` doesn't have, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def save_artifact(df: DataFrame, path: str, meta: dict) -> None:
    """A table with its schema version and fingerprint.

    The data goes to a folder of its own, and the mark, written last, names it: a reader sees the old table or the
    new one, never half of one.
    """
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    mark = json.dumps({"meta": meta, "data": name}, sort_keys=True)
    df.sparkSession.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("append").json(f"{path}/marks/{_next_mark(df.sparkSession, path):09d}")


def load_artifact(spark: SparkSession, path: str, **expected) -> DataFrame:
    """The table, if its mark says what is expected."""
    last = _next_mark(spark, path) - 1
    if last < 0:
        raise FileNotFoundError(f"no artifact at {path}")
    mark = json.loads(spark.read.schema("mark string").json(f"{path}/marks/{last:09d}").first()[0])
    meta = mark["meta"]
    wrong = {k: (meta.get(k), v) for k, v in expected.items() if meta.get(k) != v}
    if wrong:
        raise ValueError(f"artifact at {path} differs: {wrong}")
    return spark.read.parquet(f"{path}/{mark['data']}")


def save_consensus(edges: DataFrame, path: str, num_nodes: int = 0, **meta) -> None:
    """A fixed support with its node count (one more than the largest id, unless given) and what else is to be known of it."""
    n = num_nodes or (edges.agg(F.max(F.greatest("u", "v"))).first()[0] or 0) + 1
    save_artifact(edges.select("u", "v"), path, {**meta, "num_nodes": int(n), "kind": "consensus"})


def load_consensus(spark: SparkSession, path: str) -> DataFrame:
    """``(u, v)`` of a support; refused unless all edges are canonical, unique and within its nodes."""
    t = load_artifact(spark, path, kind="consensus")
    mark = json.loads(spark.read.schema("mark string").json(f"{path}/marks/{_next_mark(spark, path) - 1:09d}").first()[0])
    n = mark["meta"]["num_nodes"]
    fit = (F.col("u") < F.col("v")) & (F.col("u") >= 0) & (F.col("v") < n)
    if t.where(~F.coalesce(fit, F.lit(False))).limit(1).count():
        raise ValueError(f"{path}: edges that are not canonical or lie outside of {n} nodes")
    if t.groupBy("u", "v").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: edges that stand twice")
    return t


def _next_mark(spark: SparkSession, path: str) -> int:
    """One more than the last mark that was written whole."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/marks/*/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return max((int(f.getPath().getParent().getName()) for f in found or []), default=-1) + 1


# The columns of a ledger row, in order.
METRICS = "method dataset run seed epochs kept_ratio sparsity status metric train_acc valid_acc test_acc train_f1_macro test_f1_macro chosen_epoch log_file raw_results initial_sparsification_time_sec resparsification_time_sec sparsification_time_sec training_time_sec total_runtime_sec train_only_time_sec eval_time_sec selection_time_sec".split()


def append_metrics(rows: DataFrame, path: str) -> None:
    """Add rows to a ledger of METRICS: columns that are missing are empty, unknown ones an error; each call adds a file of its own."""
    odd = [c for c in rows.columns if c not in METRICS]
    if odd:
        raise ValueError(f"not columns of the ledger: {odd}")
    cells = [(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in METRICS]
    rows.select(*cells).write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in METRICS)).csv(path)


def save_bank(views: DataFrame, path: str, view: str = "view_id") -> None:
    """A bank of supports, one folder a view, so that a view is read by itself."""
    views.write.mode("overwrite").partitionBy(view).parquet(path)


def load_bank(spark: SparkSession, path: str, view: int | None = None, column: str = "view_id") -> DataFrame:
    out = spark.read.parquet(path)
    return out if view is None else out.where(F.col(column) == view)


def fingerprint(edges: DataFrame) -> str:
    """A hash of an edge set that doesn't depend on the order of its rows."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(json.dumps([r["n"], r["x"], r["s"]]).encode()).hexdigest()


def cached(spark: SparkSession, identity: dict, build, root: str | None = None) -> DataFrame:
    """The table built for an identity, kept under the first 16 digits of its hash."""
    path = f"{root or shared_dir(spark) + '/cache'}/{hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()[:16]}"
    if not _next_mark(spark, path):
        save_artifact(build(), path, identity)
    return load_artifact(spark, path, **identity)
