"""Attention of all nodes to all nodes without pairs, by positive random features of the softmax kernel."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import dropped, stored


def hashed(*parts) -> float:
    """A number in (0, 1) from the md5 of some values."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def normal(*parts) -> float:
    return math.sqrt(-2 * math.log(hashed(*parts, "r"))) * math.cos(2 * math.pi * hashed(*parts, "a"))


def rotation(d: int, *parts) -> np.ndarray:
    """An orthogonal matrix: ``2 d ceil(ln d)`` rotations of two hashed rows by a hashed angle."""
    q = np.eye(d)
    if d < 2:
        return q
    for t in range(2 * d * max(1, math.ceil(math.log(d)))):
        i = int(hashed(*parts, t, "i") * d)
        j = (i + 1 + int(hashed(*parts, t, "j") * (d - 1))) % d
        c, s = (f(2 * math.pi * hashed(*parts, t, "angle")) for f in (math.cos, math.sin))
        q[[i, j]] = np.stack([c * q[i] + s * q[j], c * q[j] - s * q[i]])
    return q


def projections(m: int, d: int, seed: int = 0, even: bool = False) -> np.ndarray:
    """m directions of d numbers, orthogonal within blocks of d, as long as hashed normal vectors (or, ``even``, the root of d)."""
    rows = np.concatenate([rotation(d, seed, b) for b in range(-(-m // d))])[:m]
    length = [math.sqrt(d) if even else math.sqrt(sum(normal(seed, "n", r, k) ** 2 for k in range(d))) for r in range(m)]
    return rows * np.array(length)[:, None]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), d)


def _logs(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logarithms of the features: direction times vector less half its square, vectors over the fourth root of their length."""
    x = x / x.shape[1] ** 0.25
    return x @ w.T - 0.5 * (x * x).sum(1)[:, None]


def kernel_attention(nodes: DataFrame, m: int = 256, seed: int = 0, query: str = "q", keys: str = "k", values: str = "v", eps: float = 0.0) -> DataFrame:
    """``(node, out)``: for each node the mean of all ``values``, weighted by ``exp(query . keys / sqrt(d))``, estimated with m features.

    Keys and values are summed in one pass into m sums (one row a feature leaves a partition), and queries are
    weighed with these in another; the sums are the only thing that all tasks get, m times the length of a value. Vectors
    that are null are in no sum and have none; all others must have one length, as must values.
    """
    spark = nodes.sparkSession
    t = nodes.select("node", F.col(query).cast("array<double>").alias("q"), F.col(keys).cast("array<double>").alias("k"), F.col(values).cast("array<double>").alias("v"))
    held = t.where("k IS NOT NULL AND v IS NOT NULL")
    first = held.select(F.size("k").alias("d"), F.size("v").alias("c")).first()
    if first is None:
        return spark.createDataFrame([], "node long, out array<double>")
    d, c = first["d"], first["c"]
    w = projections(m, d, seed)

    def summed(batches):
        top, total = None, None
        for b in batches:
            if not len(b):
                continue
            logs, v = _logs(_matrix(b.column(0), d), w), _matrix(b.column(1), c)
            new = logs.max()
            e = np.exp(logs - new)
            part = np.concatenate([e.sum(0)[:, None], e.T @ v], 1)
            if top is None:
                top, total = new, part
            else:
                most = max(top, new)
                top, total = most, total * np.exp(top - most) + part * np.exp(new - most)
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([total.ravel().tolist()])], ["top", "sums"])

    parts = stored(held.select("k", "v").mapInArrow(summed, "top double, sums array<double>"), "attention")
    most = F.lit(parts.agg(F.max("top")).first()[0])
    scaled = parts.select(F.posexplode(F.transform("sums", lambda x: x * F.exp(F.col("top") - most))).alias("i", "x"))
    sums = np.array([r["x"] for r in scaled.groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]).reshape(m, 1 + c)
    dropped(parts)

    def weighed(batches):
        for b in batches:
            logs = _logs(_matrix(b.column(1), d), w)
            e = np.exp(logs - logs.max(1)[:, None]) + eps
            out = e @ sums
            out = out[:, 1:] / out[:, :1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["node", "out"])

    return t.where("q IS NOT NULL").select("node", "q").mapInArrow(weighed, "node long, out array<double>")

