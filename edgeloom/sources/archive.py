"""Array archives (``.npz``) as a data source read by slices, and the graphs, splits and resistances that they hold.

``spark.read.format("array_archive").schema("node long, y long").load(path)`` reads arrays by the names of the columns: one number a row of an
array of one dimension, an array a row of one of two. A column ``node`` that no array has is the row's number; ``src`` and ``dst`` that no array
has are the rows (or columns) of ``edges`` or ``edge_index``. Arrays that the schema does not name are not read, and each partition reads
its slice of the others only, so no task holds a whole array. Files must be on a path that all executors can open.
"""

from __future__ import annotations

import ast
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from edgeloom.operators.edges import nodes
from edgeloom.operators.metrics import random_split
from edgeloom.sources.files import cached, fingerprint

PAIRS = ("edges", "edge_index")


def _opened(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(pa.PythonFile(system.open_input_file(name), mode="r"))


def _header(f) -> tuple[np.dtype, tuple, bool]:
    """Type, shape and order of the array that a stream begins with."""
    start = f.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an array")
    size = struct.unpack("<H", f.read(2))[0] if start[6] == 1 else struct.unpack("<I", f.read(4))[0]
    d = ast.literal_eval(f.read(size).decode("latin1"))
    if np.dtype(d["descr"]).hasobject:
        raise ValueError("arrays of objects are not read: they can run code")
    return np.dtype(d["descr"]), tuple(d["shape"]), d["fortran_order"]


def shapes(path: str) -> dict[str, tuple[np.dtype, tuple]]:
    """Type and shape of each array of an archive."""
    out = {}
    with _opened(path) as z:
        for name in z.namelist():
            with z.open(name) as f:
                kind, shape, _ = _header(f)
                out[name.removesuffix(".npy")] = (kind, shape)
    return out


def _run(path: str, name: str, first: int, n: int) -> np.ndarray:
    """n numbers of an array as they stand in the file, from the first-th on."""
    with _opened(path) as z, z.open(name + ".npy") as f:
        kind, _, _ = _header(f)
        skip = first * kind.itemsize
        while skip > 0:  # a packed member is read through, a piece at a time
            skip -= len(f.read(min(skip, 1 << 20)))
        return np.frombuffer(f.read(n * kind.itemsize), kind)


def rows_of(path: str, name: str, first: int, last: int) -> np.ndarray:
    """Rows first to last of an array, without the rest of it in memory; arrays that stand in the file column by column are read by columns."""
    with _opened(path) as z, z.open(name + ".npy") as f:
        _, shape, by_column = _header(f)
    width = int(np.prod(shape[1:], dtype=np.int64))
    if by_column and width > 1:
        if len(shape) > 2:
            raise ValueError(f"{name}: more than two dimensions, column by column")
        return np.stack([_run(path, name, j * shape[0] + first, last - first) for j in range(width)], 1)
    return _run(path, name, first * width, (last - first) * width).reshape(last - first, *shape[1:])


def row_part(path: str, name: str, row: int, first: int, last: int) -> np.ndarray:
    """Numbers first to last of one row of a wide array."""
    with _opened(path) as z, z.open(name + ".npy") as f:
        _, shape, by_column = _header(f)
    if by_column:
        return _run(path, name, first * shape[0], (last - first) * shape[0]).reshape(-1, shape[0])[:, row]
    return _run(path, name, row * shape[1] + first, last - first)


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, slices: int):
        self.schema, self.path, self.slices = schema, path, slices
        self.known = shapes(path)
        self.pair = next((p for p in PAIRS if p in self.known), None)
        lengths = {self._length(f.name) for f in schema if self._length(f.name) is not None}
        if len(lengths) > 1:
            raise ValueError(f"{path}: columns of different lengths: {sorted(lengths)}")
        self.n = lengths.pop() if lengths else 0

    def _upright(self) -> bool:
        shape = self.known[self.pair][1]
        return shape[0] != 2 or shape[1] == 2 and len(shape) == 2 and self.pair == "edges"

    def _length(self, name: str) -> int | None:
        if name in self.known:
            return self.known[name][1][0] if self.known[name][1] else 1
        if name in ("src", "dst") and self.pair:
            return self.known[self.pair][1][0 if self._upright() else 1]
        if name == "node":
            return None
        raise ValueError(f"{self.path} has no array {name}")

    def partitions(self) -> list[Slice]:
        step = max(1, -(-self.n // self.slices))
        return [Slice(i, min(self.n, i + step)) for i in range(0, self.n, step)] or [Slice(0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        columns, a, b = [], part.first, part.last
        for f in self.schema:
            if f.name in self.known:
                x = rows_of(self.path, f.name, a, b) if self.known[f.name][1] else rows_of(self.path, f.name, 0, 1).reshape(1)
            elif f.name == "node":
                x = np.arange(a, b)
            elif self._upright():
                x = rows_of(self.path, self.pair, a, b)[:, ("src", "dst").index(f.name)]
            else:
                x = row_part(self.path, self.pair, ("src", "dst").index(f.name), a, b)
            inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else f.dataType
            kind = {LongType(): np.int64, DoubleType(): np.float64, BooleanType(): bool}.get(inner)
            values = pa.array(np.ascontiguousarray(x).astype(kind).ravel() if kind else np.ascontiguousarray(x).astype(str).ravel().tolist())
            if isinstance(f.dataType, ArrayType):
                width = int(np.prod(x.shape[1:], dtype=np.int64))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), values)
            columns.append(values)
        yield pa.RecordBatch.from_arrays(columns, self.schema.fieldNames())


class ArrayArchive(DataSource):
    """Format ``array_archive``; option ``slices`` (8): partitions."""

    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> StructType:
        """All arrays that have the commonest number of rows."""
        known = {k: v for k, v in shapes(self.options["path"]).items() if v[1] and k not in PAIRS}
        lengths = [s[0] for _, s in known.values()]
        n = max(set(lengths), key=lambda x: (lengths.count(x), x)) if lengths else 0
        simple = lambda k: {"b": BooleanType(), "i": LongType(), "u": LongType(), "f": DoubleType()}.get(k.kind, StringType())
        return StructType([StructField(k, simple(t) if len(s) == 1 else ArrayType(simple(t))) for k, (t, s) in known.items() if s[0] == n])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options["path"], int(self.options.get("slices", 8)))


def read_arrays(spark: SparkSession, path: str, schema: str | None = None, slices: int = 8) -> DataFrame:
    spark.dataSource.register(ArrayArchive)
    r = spark.read.format("array_archive").option("slices", slices)
    return (r.schema(schema) if schema else r).load(path)


def fixed_splits(spark: SparkSession, path: str) -> DataFrame:
    """``(split_id, node, part)`` of an archive: lists of nodes ``train``, ``valid``, ``test``, or masks ``train_mask``, ``val_mask``, ``test_mask``.

    Masks have one column a split; one of one dimension stands in every split. Where there is a ``stopping_mask``, ``valid`` is either of the two.
    Refused if a node is in two parts of a split, twice in one, or a part is missing.
    """
    known = shapes(path)
    if "train" in known:
        found = [read_arrays(spark, path, f"{k} {'boolean' if known[k][0] == bool else 'long'}") for k in ("train", "valid", "test")]
        parts = [
            (read_arrays(spark, path, f"node long, {k} boolean").where(k) if known[k][0] == bool else t.withColumnRenamed(k, "node")).select(F.lit(0).alias("split_id"), "node", F.lit(k).alias("part"))
            for k, t in zip(("train", "valid", "test"), found)
        ]
    else:
        width = max(known[k][1][1] if len(known[k][1]) == 2 else 1 for k in ("train_mask", "val_mask", "test_mask"))
        parts = []
        for part, names in (("train", ["train_mask"]), ("valid", ["val_mask", "stopping_mask"]), ("test", ["test_mask"])):
            names = [k for k in names if k in known]
            t = read_arrays(spark, path, ", ".join(["node long", *(f"{k} {'array<boolean>' if len(known[k][1]) == 2 else 'boolean'}" for k in names)]))
            wide = [F.col(k) if len(known[k][1]) == 2 else F.array_repeat(F.col(k), width) for k in names]
            flags = wide[0] if len(wide) == 1 else F.zip_with(*wide, lambda a, b: a | b)
            parts.append(t.select("node", F.posexplode(flags).alias("split_id", "in")).where("in").select("split_id", "node", F.lit(part).alias("part")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    twice = out.groupBy("split_id", "node").count().where("count > 1").limit(1).count()
    full = out.select("split_id", "part").distinct().groupBy("split_id").count().where("count < 3").limit(1).count()
    if twice or full or not out.limit(1).count():
        raise ValueError(f"{path}: a node stands in a split twice, or a part is empty")
    return out


def split_for_run(splits: DataFrame, run: int = 0) -> DataFrame:
    """``(node, part)`` of the split of a run: splits take turns."""
    n = splits.agg(F.max("split_id")).first()[0] + 1
    return splits.where(F.col("split_id") == run % n).select("node", "part")


def finalised(node_table: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, x, y)``: whole-number labels (-1 for none), doubles as features; nodes without features have their degree's logarithm."""
    have = set(node_table.columns)
    y = F.coalesce(F.col("y").cast("long"), F.lit(-1)) if "y" in have else F.lit(-1).cast("long")
    if "x" in have:
        return node_table.select("node", F.col("x").cast("array<double>").alias("x"), y.alias("y"))
    ends = edges.select(F.explode(F.array(*[c for c in ("u", "v", "src", "dst") if c in edges.columns])).alias("node"))
    deg = ends.groupBy("node").agg(F.count("*").alias("deg"))
    return node_table.join(deg, "node", "left").select("node", F.array(F.log1p(F.coalesce("deg", F.lit(0)).cast("double"))).alias("x"), y.alias("y"))


def cached_split(labelled: DataFrame, name: str, seed: int = 0, train: float = 0.5, valid: float = 0.25, root: str | None = None) -> DataFrame:
    """``(node, part)``: a hashed random split of the labelled nodes, kept under its name, ratios, seed and node set, so later runs read the same one."""
    spark = labelled.sparkSession
    among = labelled.where("y >= 0").select("node") if "y" in labelled.columns else labelled.select("node")
    identity = {"split": name, "train": train, "valid": valid, "seed": seed, "nodes": fingerprint(among.select(F.col("node").alias("u"), F.col("node").alias("v")))}
    return cached(spark, identity, lambda: random_split(among, train, valid, seed).select("node", "part"), root)


def resistances(spark: SparkSession, path: str, edges: DataFrame) -> DataFrame:
    """``(u, v, w, leverage)`` of an archive with ``src``, ``dst``, ``conductance`` and ``leverage_score`` or ``resistance``, checked against the graph while it is read.

    Each edge of ``edges`` must stand in it once, in either direction, and nothing else; conductances must be finite and above 0, leverages finite and not below 0. Else it is refused.
    """
    known = shapes(path)
    score = "leverage_score" if "leverage_score" in known else "resistance"
    if score not in known:
        raise ValueError(f"{path} has neither leverage_score nor resistance")
    t = read_arrays(spark, path, f"src long, dst long, conductance double, {score} double")
    leverage = F.col(score) if score == "leverage_score" else F.col("conductance") * F.col(score)
    t = t.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.col("conductance").alias("w"), leverage.alias("leverage"))
    both = t.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("w").alias("w"), F.max("leverage").alias("leverage")).join(edges.select("u", "v", F.lit(1).alias("in")), ["u", "v"], "full_outer")
    bad = F.col("n").isNull() | (F.col("n") > 1) | F.col("in").isNull() | ~(F.col("w") > 0) | F.col("w").isin(float("inf"), float("nan")) | ~(F.col("leverage") >= 0) | F.col("leverage").isin(float("inf"), float("nan"))
    wrong = both.where(bad).limit(1).collect()
    if wrong:
        raise ValueError(f"{path} does not fit the graph, first at {json.dumps(wrong[0].asDict())}")
    return t
