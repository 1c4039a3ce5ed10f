"""Graphs read from ordinary tables. Every view ends in canonical edges ``(u, v, w)``, ``u < v``, unique."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.session import join_counted, stored

#: Added to the ids of the second kind of node of a bipartite view.
OFFSET = 1_000_000_000
#: Vectors of a block in the exact search by squared distance.
BLOCK = 4096
#: Vectors of a block in the exact search by cosine: at most, and where eight blocks are made.
LARGE, SMALL = 16_384, 4096
#: Rows and columns of a matrix product of the search, which stays in a core's cache, and pairs that are computed in double precision at once.
ROWS, COLUMNS, PAIRS = 256, 2048, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_supplier(spark, sf_dir) -> DataFrame:
    """Parts and suppliers, weighted by quantity."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + OFFSET).alias("v")).agg(F.sum("l_quantity").alias("w"))


def customer_supplier(spark, sf_dir) -> DataFrame:
    """Customers and the suppliers of their orders, weighted by line items."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(t, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + OFFSET).alias("v")).agg(F.count("*").cast("double").alias("w"))


def transitions(spark, sf_dir) -> DataFrame:
    """Directed, with repeats and loops: each event's user and the user of the next event of the same day and type."""
    w = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return t.where("dst IS NOT NULL")


def user_graph(spark, sf_dir) -> DataFrame:
    """Users whose events follow each other, weighted by how often."""
    t = transitions(spark, sf_dir).where("src <> dst")
    return t.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").cast("double").alias("w"))


def event_types(spark, sf_dir) -> DataFrame:
    """Users and the types of their events; a type's node is its place in the alphabet."""
    t = table(spark, sf_dir, "events")
    kinds = t.select("event_type").distinct().withColumn("v", F.row_number().over(Window.orderBy("event_type")) + OFFSET)
    return t.groupBy(F.col("user_id").alias("u"), "event_type").agg(F.count("*").cast("double").alias("w")).join(F.broadcast(kinds), "event_type").select("u", F.col("v").cast("long").alias("v"), "w")


def vectors(spark, sf_dir) -> DataFrame:
    """Nodes with features ``x`` (array of double) and label ``y``."""
    t = table(spark, sf_dir, "embeddings")
    return t.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))


def _matrix(x: pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as rows of a matrix; null elements are not numbers."""
    a = x.combine_chunks()
    if a.null_count or len(pc.unique(pc.list_value_length(a))) > 1:
        raise ValueError("vectors that are null or of different lengths")
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(a), -1)


class _Block:
    """Unit vectors of a block, equal ones once: ``ids[first[g]:first[g] + size[g]]`` are those of the g-th, ascending."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        _, at, same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, same))
        self.x, self.ids = x[at], ids[order]
        self.first = np.flatnonzero(np.diff(same[order], prepend=-1))
        self.size = np.diff(self.first, append=len(x))
        self.low = self.x.astype(np.float32)

    def members(self, groups: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some groups, the ``most`` smallest of each, and the place in ``groups`` that each comes from."""
        n = self.size[groups] if most is None else np.minimum(self.size[groups], most)
        at = np.repeat(np.arange(len(groups)), n)
        return self.ids[self.first[groups][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)], at


def _tops(s: np.ndarray, k: int, before: np.ndarray | None = None) -> np.ndarray:
    """For each row k + 1 values that different columns reach, or all it has, the least first; ``before`` are those of other columns."""
    groups = max(2 * k + 2, 128)
    g = s if s.shape[1] < 2 * groups else s[:, : s.shape[1] // groups * groups].reshape(len(s), -1, groups).max(1)
    g = g if before is None else np.concatenate([before, g], axis=1)
    return g if g.shape[1] <= k + 1 else np.partition(g, g.shape[1] - k - 1, axis=1)[:, -k - 1 :]


def _least(tops: np.ndarray, k: int) -> np.ndarray:
    return tops[:, 0] if tops.shape[1] > k else np.full(len(tops), -np.inf, np.float32)


def _where(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few places that are true."""
    if hit.size % 8:
        return np.nonzero(hit)
    words = np.flatnonzero(hit.reshape(-1).view(np.uint64))
    at, bit = np.nonzero(hit.reshape(-1, 8)[words])
    return np.divmod(words[at] * 8 + bit, hit.shape[1])


def _largest(found: list, k: int, slack: np.float32) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Of pairs ``(i, j, s)`` those that reach, less ``slack``, the (k + 1)-th largest s of their i; and that s, for each i that has as many."""
    i, j, s = (np.concatenate([f[c] for f in found]) for c in range(3))
    bits = s.astype(np.float32).view(np.uint32)
    falling = np.where(bits >> 31, bits, ~bits & np.uint32(0x7FFFFFFF))
    order = np.argsort(i.astype(np.uint64) << np.uint64(32) | falling)
    i, j, s = i[order], j[order], s[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    many = np.diff(first, append=len(i))
    keep = s >= np.repeat(s[first + np.minimum(many, k + 1) - 1], many) - slack
    full = first[many > k]
    return (i[keep], j[keep], s[keep]), i[full], s[full + k]


def _first(i: np.ndarray, s: np.ndarray, n: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the pairs that reach, less ``slack``, the (k + 1)-th largest ``s`` of their ``i``, where a pair counts ``n`` times."""
    order = np.lexsort((-s, i))
    i, s, n = i[order], s[order], n[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    many = np.diff(first, append=len(i))
    upto = np.cumsum(n)
    last = np.minimum(np.searchsorted(upto, upto[first] - n[first] + k + 1), first + many - 1)
    return order[s >= np.repeat(s[last], many) - slack]


def _pairs(x: _Block, y: _Block, k: int, both: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(i, j)`` of groups that may be among the k + 1 nearest: for each group of x those of y, then, if ``both``, for each of y those of x.

    Each product serves both directions. Bounds rise as more is seen; what is too far by more than the error of single precision is left out.
    """
    margin = np.float32(4e-9 + (x.x.shape[1] + 8) * float(np.finfo(np.float32).eps))
    tiles = [np.ascontiguousarray(y.low[b : b + COLUMNS].T) for b in range(0, len(y.low), COLUMNS)]
    of_x: list = []
    of_y: list = []
    if both:
        some = np.ascontiguousarray(x.low[:COLUMNS].T)
        bound_y = np.concatenate([_least(_tops(y.low[a : a + ROWS] @ some, k), k) for a in range(0, len(y.low), ROWS)]) - margin
    held, rise = 0, 2 * COLUMNS
    for a in range(0, len(x.low), ROWS):
        rows: list = []
        tops = None
        for b, tile in enumerate(tiles):
            s = x.low[a : a + ROWS] @ tile
            if b & (b - 1) == 0:
                tops = _tops(s, k, tops)
                bound_x = _least(tops, k)[:, None] - margin
            i, j = _where(s >= bound_x)
            rows.append((a + i, b * COLUMNS + j, s[i, j]))
            if both:
                i, j = _where(s >= bound_y[b * COLUMNS : b * COLUMNS + s.shape[1]])
                of_y.append((b * COLUMNS + j, a + i, s[i, j]))
                held += len(i)
        of_x.append(_largest(rows, k, margin)[0])
        if both and (a + ROWS >= rise or held > 20 * PAIRS):
            kept, i, least = _largest(of_y, k, margin)
            bound_y[i] = np.maximum(bound_y[i], least - margin)
            of_y, held, rise = [kept], 0, max(rise, 2 * (a + ROWS))
    found = [of_x, [_largest(of_y, k, margin)[0]]] if both else [of_x]
    return [tuple(np.concatenate([f[c] for f in side]) for c in range(2)) for side in found]


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray | None, others: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(id, other id, cos)`` of unit rows, with at least the k others of a block that are nearest by cosine to 9 digits, ties by id, if it has as many.

    For each row of x those of y and for each row of y those of x; without y, for each row of x the others of x. Products in single precision leave
    out what is too far by more than their error; the rest is computed in double precision. Of equal rows the k + 1 smallest ids are enough, as a node is no
    neighbour of itself.
    """
    one = _Block(x, ids)
    two = one if y is None else _Block(y, others)
    out: list[list] = [[], [], []]
    for (p, q), (i, j) in zip(((one, two), (two, one)), _pairs(one, two, k, y is not None)):
        cos = np.concatenate([np.einsum("ij,ij->i", p.x[i[b : b + PAIRS]], q.x[j[b : b + PAIRS]]) for b in range(0, len(i), PAIRS)] or [np.empty(0)])
        near = _first(i, cos, np.minimum(q.size[j], k + 1), k, 2e-9)  # what rounding may make equal to the last stays
        i, j, cos = i[near], j[near], cos[near]
        found, at = q.members(j, k + 1)
        asks, of = p.members(i[at])
        found, cos = found[of], cos[at][of]
        apart = asks != found
        for column, values in zip(out, (asks[apart], found[apart], cos[apart])):
            column.append(values)
    return tuple(np.concatenate(c) for c in out)


def nearest(nodes: DataFrame, k: int = 8, dilation: int = 1) -> DataFrame:
    """``(src, rank, dst, cos)``: exact cosine neighbours, without the node itself, ties by id; with a dilation every d-th.

    Blocks of nodes meet in pairs, each pair once and in a partition of its own up to 4,096 pairs, for both of its directions; only about k * d rows a
    node (and ties) leave a pair of blocks, so memory is bounded; the work is quadratic, as an exact graph's is. Every vector is sent to
    as many tasks as there are blocks. Vectors with a number that is not finite have no neighbours.
    """
    k *= dilation
    m = nodes.count()
    n = max(1, -(-m // LARGE), min(8, -(-m // SMALL)))
    b = nodes.select("node", "x").withColumn("b", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
    both = b.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    both = both.select("node", "x", (F.col("b") <= F.col("other")).alias("asks"), (F.least("b", "other") * n + F.greatest("b", "other")).alias("pair"))
    both = both.repartitionByRange(min(4096, n * (n + 1) // 2), "pair")

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("x"))
        x = x / np.maximum(1e-12, np.sqrt((x * x).sum(1)))[:, None]
        asks, ids = t.column("asks").to_numpy(zero_copy_only=False), t.column("node").to_numpy()
        own = t.column("pair")[0].as_py() % (n + 1) == 0
        fine = np.isfinite(x).all(1)
        q, r = np.flatnonzero(asks & fine), np.flatnonzero(~asks & fine)
        found = (ids[:0], ids[:0], np.empty(0))
        if len(q) and (own or len(r)):
            found = _best(x[q], ids[q], *((None, None) if own else (x[r], ids[r])), k)
        return pa.table(list(found), ["src", "dst", "cos"])

    w = Window.partitionBy("src").orderBy(F.round("cos", 9).desc(), "dst")
    out = both.groupBy("pair").applyInArrow(run, "src long, dst long, cos double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.where((F.col("rank") - 1) % dilation == 0).select("src", "rank", "dst", "cos")


def nearest_squared(nodes: DataFrame, k: int = 8, dilation: int = 1, batch: str | None = None, seed: int | None = None) -> DataFrame:
    """``(src, rank, dst, d2)``: nearest by squared distance, the node itself among them, ties by id.

    With ``batch`` a node has neighbours of its own batch only, null being one. With a dilation the nearest k * d are
    found first; then every d-th is kept or, with a seed, k of them in hash order, which are ranked anew by distance.
    A batch is cut into blocks of BLOCK nodes whose pairs are tasks, and k * d rows a node leave each.
    """
    from edgeloom.operators.edges import key

    most = k * dilation
    b = nodes.select("node", "x", (F.col(batch) if batch else F.lit(None)).cast("string").alias("batch")).withColumn("__b", F.xxhash64(F.col("batch").isNull(), "batch"))
    sizes = b.groupBy("__b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    b = join_counted(b, sizes, ["__b"], sizes.count()).withColumn("b", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    both = b.withColumn("asks", F.lit(True)).withColumn("i", F.col("b")).withColumn("j", every).unionByName(b.withColumn("asks", F.lit(False)).withColumn("j", F.col("b")).withColumn("i", every))

    def run(t: pa.Table) -> pa.Table:
        x = np.array(t.column("x").to_pylist())
        asks, ids = t.column("asks").to_numpy(zero_copy_only=False), t.column("node").to_numpy()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        r = r[np.argsort(ids[r])]
        length = (x * x).sum(1)
        d = np.maximum(0.0, np.round(length[q][:, None] + length[r][None] - 2 * x[q] @ x[r].T, 9))
        best = np.argsort(d, axis=1, kind="stable")[:, :most]
        return pa.table([np.repeat(ids[q], best.shape[1]), ids[r][best].ravel(), np.take_along_axis(d, best, 1).ravel()], ["src", "dst", "d2"])

    w = Window.partitionBy("src").orderBy("d2", "dst")
    out = both.groupBy("__b", "i", "j").applyInArrow(run, "src long, dst long, d2 double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    if dilation > 1 and seed is not None:
        drawn = Window.partitionBy("src").orderBy(key("src", "dst", seed=seed), "dst")
        out = out.withColumn("__r", F.row_number().over(drawn)).where(F.col("__r") <= k).withColumn("rank", F.row_number().over(w))
    else:
        out = out.where((F.col("rank") - 1) % dilation == 0)
    return out.select("src", F.col("rank").cast("long").alias("rank"), "dst", "d2")


def knn_graph(spark, sf_dir, k: int = 8) -> DataFrame:
    """Cosine neighbours of the embeddings, either way, weighted 1; stored, as every use would search anew."""
    t = nearest(vectors(spark, sf_dir), k)
    return stored(t.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("w", F.lit(1.0)), "knn")


# The same views for DuckDB.
SQL = {
    "ps": f"SELECT l_partkey AS u, l_suppkey + {OFFSET} AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2",
    "cs": f"SELECT o_custkey AS u, l_suppkey + {OFFSET} AS v, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "tr": "SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL",
    "ug": "SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*)::DOUBLE AS w FROM tr WHERE src <> dst GROUP BY 1, 2",
    "nn": "SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 8",
    "kg": "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, 1.0::DOUBLE AS w FROM nn",
}


def sql(body: str, *views: str) -> str:
    """A query over some of the views, which it may name; each brings those it reads."""
    need = {"ug": ["tr"], "kg": ["nn"]}
    names: list[str] = []
    for v in views:
        names += [x for x in [*need.get(v, []), v] if x not in names]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}" if head else body
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}" if head else body
    return f"WITH {head} {body}" if head else body
