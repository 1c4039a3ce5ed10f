"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one node with a count.
2. A rotation is learned from a bounded sample (iterative quantisation: codes are the signs of rotated
   vectors, and the rotation is the one that fits vectors and codes best, in turns).
3. Each of TABLES tables looks at BITS bits of the code. A node stands in every table under its
   own bits and is looked for under all bits that differ in at most one place. So that a task
   holds a bounded part of a table, the first few bits choose the part, and a node is also sent to
   the smaller of the parts that its own differ from in one bit. A part above PART nodes, such as one with a dense
   cluster, is cut into blocks by a hash, and its pairs of blocks are tasks of their own.
4. What is found is sorted out by all bits of the code (a pair at the threshold differs in more than five standard
   deviations above its mean number of bits with a chance of about 3 in a million) and reranked with the vectors in
   double precision. A pair is judged only in the first table that finds it, so links can be counted without
   gathering pairs; each part of a table gives sums per node and edges that span its components.

For cosine 0.9 two codes differ in a bit with chance 0.144, so a table of 12 bits finds the pair with
chance 0.47. The tables share the bits of one code and are not independent: on 200,000 random pairs of
64 numbers with 64 random orthogonal bits, 12 tables missed 0.53 % at cosine 0.9, 0.21 % at 0.92 and
0.02 % at 0.95. The width doesn't grow with the input, as wider tables miss more (5.6 % at 0.9 with 16 bits).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.llm.common import give_back, mix, small_batches, table
from edgeloom.operators.components import components, smallest_labels
from edgeloom.session import join_counted, stored

#: The bound of the sample that a rotation is learned from.
SAMPLE = 4000
#: Longest code, tables, bits of a table at every size of input, and nodes a part.
CODE, TABLES, BITS, PART = 64, 12, 12, 16_000
#: Pairs that are held at once.
CHUNK = 1 << 20


def rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """A matrix from unit vectors to ``bits`` numbers whose signs are the code: projection, then rotation."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    values, vectors = np.linalg.eigh(x.T @ x + 1e-9 * np.eye(d))
    project = vectors[:, ::-1][:, :bits]
    v = x @ project
    r = np.linalg.qr(rng.standard_normal((project.shape[1], project.shape[1])))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(b.T @ v)
        r = (u @ wt).T
    return project @ r


def picks(bits: int, width: int, tables: int, seed: int = 2) -> np.ndarray:
    """The bits each table looks at: cut from one shuffle of the code after another."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = []
    while len(out) < tables:
        p = rng.permutation(bits)
        out += [p[i : i + width] for i in range(0, bits - width + 1, width)]
    return np.array(out[:tables])


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column of one length, in double precision, and their lengths."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return flat, np.sqrt(np.einsum("ij,ij->i", flat, flat))


def far_bits(bits: int, least: float) -> int:
    """How many of ``bits`` bits of a pair at the threshold may differ: five standard deviations above the mean."""
    p = float(np.arccos(min(1.0, max(-1.0, least))) / np.pi)
    return int(np.ceil(bits * p + 5 * np.sqrt(bits * p * (1 - p))))


def packed_bits(code: np.ndarray) -> np.ndarray:
    """Rows of up to 64 booleans as numbers."""
    return (code * (np.uint64(1) << np.arange(code.shape[1], dtype=np.uint64))).sum(1, dtype=np.uint64)


def part_links(x: np.ndarray, code: np.ndarray, own: np.ndarray, weight: np.ndarray, sets: np.ndarray, t: int, least: float, side: np.ndarray | None = None):
    """Links of one part of table ``t``: weighted link counts of the nodes that are at home here or visit, and spanning pairs.

    A pair is kept where table ``t`` is the first that finds it, and where at least one node is at
    home. With ``side``, the blocks of a cut part, the two are in different blocks.
    """
    width = sets.shape[1]
    packed = np.stack([(code[:, s] * (1 << np.arange(width))).sum(1) for s in sets])  # of every table
    whole, far = packed_bits(code), far_bits(code.shape[1], least)
    mine = packed[t]
    order = np.argsort(mine, kind="stable")
    keys = mine[order]
    count = np.zeros(len(x), np.int64)
    u, v = [], []
    flips = np.concatenate([[0], 1 << np.arange(width)])
    for f in flips:
        from_ = np.flatnonzero((mine & f) == 0)  # of the two ways to see a pair the one that sets the bit
        want = mine[from_] ^ f
        lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, "right")
        many = hi - lo
        ends = np.cumsum(many)
        start = 0
        while start < len(from_):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK)))
            m = many[start:stop]
            if m.sum():
                a = np.repeat(from_[start:stop], m)
                e = np.cumsum(m)
                b = order[np.repeat(lo[start:stop] - e + m, m) + np.arange(e[-1])]
                keep = np.bitwise_count(whole[a] ^ whole[b]) <= far
                if not f:
                    keep &= a < b
                a, b = a[keep], b[keep]
                keep = own[a] | own[b]
                if side is not None:
                    keep &= side[a] != side[b]
                a, b = a[keep], b[keep]
                for s in range(t):
                    d = packed[s][a] ^ packed[s][b]
                    later = (d & (d - 1)) != 0
                    a, b = a[later], b[later]
                for i in range(0, len(a), 1 << 16):
                    p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= least
                    p, q = p[near], q[near]
                    count += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
                    if len(p):
                        nodes, low = smallest_labels(p, q)
                        u.append(nodes[nodes != low])
                        v.append(low[nodes != low])
            start = stop
    none = np.empty(0, np.int64)
    return count, np.concatenate([none, *u]), np.concatenate([none, *v])


class _Deal:
    """Which parts of each table a node goes to."""

    def __init__(self, turn: np.ndarray, sets: np.ndarray, split: int):
        self.turn, self.sets, self.split = turn, sets, split

    def parts(self, vectors: np.ndarray):
        """(part, whether it is the home, places of nodes) of some vectors; a part is ``table << 20 | bits``."""
        code = (vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]) @ self.turn >= 0
        for t, s in enumerate(self.sets):
            home = (code[:, s[: self.split]] * (1 << np.arange(self.split))).sum(1) if self.split else np.zeros(len(code), np.int64)
            for f in [0, *(1 << np.arange(self.split)).tolist()]:
                at = np.arange(len(code)) if not f else np.flatnonzero(home & f)
                to = home[at] ^ f
                by = np.argsort(to, kind="stable")
                edges = np.flatnonzero(np.diff(to[by], prepend=-1)).tolist() + [len(by)]
                for i, j in zip(edges, edges[1:]):
                    yield t << 20 | int(to[by[i]]), f == 0, at[by[i:j]]


def _sizes(deal: _Deal):
    """Vectors to (part, n), how many nodes of a batch go to each part."""

    def run(batches):
        for batch in batches:
            sizes: dict[int, int] = {}
            for part, _, at in deal.parts(unit(batch.column("v"))[0]):
                sizes[part] = sizes.get(part, 0) + len(at)
            yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], ["part", "n"])

    return run


PACKED = "part long, pair long, own boolean, side int, nodes binary, weights binary, vectors binary"


def _dealt(deal: _Deal, cut: dict[int, int], kind: str):
    """Vectors to rows of PACKED: the nodes of a batch by part and, where a part is cut into blocks, by pair of blocks."""

    def run(batches):
        for batch in batches:
            x = unit(batch.column("v"))[0]
            node, w = batch.column("node").to_numpy(), batch.column("w").to_numpy()
            rows: list[tuple] = []
            for part, own, at in deal.parts(x):
                k = cut.get(part, 1)
                block = (mix(node[at].view(np.uint64)) % np.uint64(k)).astype(np.int64)
                for b in np.unique(block).tolist() if k > 1 else [0]:
                    some = at[block == b] if k > 1 else at
                    raw = node[some].tobytes(), w[some].tobytes(), x[some].astype(kind).tobytes()
                    rows += [(part, min(b, c) * k + max(b, c), own, int(b > c), *raw) for c in range(k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [c.split()[0] for c in PACKED.split(", ")])
        give_back()

    return run


def _found(deal: _Deal, cut: dict[int, int], least: float, kind: str):
    """A part of a table, or a pair of its blocks, to (node, links, other)."""

    def found(g: pa.Table) -> pa.Table:
        part, pair = g.column("part")[0].as_py(), g.column("pair")[0].as_py()
        raw = lambda c, kind: np.frombuffer(b"".join(g.column(c).to_pylist()), kind)
        node, w = raw("nodes", np.int64), raw("weights", np.int64)
        x = raw("vectors", kind).astype(np.float64).reshape(len(node), -1)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        many = [len(b) // 8 for b in g.column("nodes").to_pylist()]
        own, side = np.repeat(g.column("own").to_numpy(zero_copy_only=False), many), np.repeat(g.column("side").to_numpy(), many)
        k = cut.get(part, 1)
        count, a, b = part_links(x, x @ deal.turn >= 0, own, w, deal.sets, part >> 20, least, side if pair // k != pair % k else None)
        some = np.flatnonzero(count)
        out = pa.table([pa.array(np.concatenate([node[some], node[a]])), pa.array(np.concatenate([count[some], np.zeros(len(a), np.int64)])), pa.array([None] * len(some) + node[b].tolist(), pa.int64())], ["node", "links", "other"])
        give_back()
        return out

    return found


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Two rows are linked when the cosine of their vectors is at least ``least``; vectors of different
    lengths never are. A null, empty or all-zero vector, or one with a null or non-finite component,
    is linked with nothing. Repeated vectors are linked with each other; rows that repeat a key are
    separate rows; ties don't arise. An empty table gives an empty one; other columns are not carried.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    element = getattr(vectors.schema[vector].dataType, "elementType", None)
    kind = "f4" if isinstance(element, T.FloatType) else "f8"
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    named = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("v"))).withColumn("again", F.when(F.col("fine"), F.xxhash64(F.lit(77), "v")))
    nodes = named.where("fine").groupBy("node", "again").agg(F.count("*").alias("w"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = stored(nodes.withColumn("d", F.size("v")), "ed-nodes")

    sums, edges = None, None
    for r in nodes.groupBy("d").agg(F.count("*").alias("n")).collect():  # lengths of vectors, one as a rule
        d, n = r["d"], r["n"]
        some = nodes.where(F.col("d") == d)
        x = np.array([q["v"] for q in some.select("node", "v").orderBy(F.xxhash64(F.lit(1), "node")).limit(SAMPLE).collect()])
        x /= np.sqrt((x * x).sum(1))[:, None]
        bits = min(d, CODE)
        turn = rotation(x, bits)
        width = min(bits, BITS)
        sets = picks(bits, width, TABLES)
        split = 0
        while (n >> split) > PART and split < width - 2:
            split += 1

        deal = _Deal(turn, sets, split)
        slim = some.select("node", "w", "v")
        sizes = slim.mapInArrow(_sizes(deal), "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * PART)
        cut = {r["part"]: -(-r["n"] // PART) for r in sizes.collect()}  # at most TABLES << split parts
        got = slim.mapInArrow(_dealt(deal, cut, kind), PACKED).groupBy("part", "pair").applyInArrow(_found(deal, cut, least, kind), "node long, links long, other long")
        got = stored(got, "ed-found")
        sums = got if sums is None else sums.unionByName(got)
    if sums is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    edges = sums.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    joined = components(edges)
    links = sums.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "again", "w", "least").join(joined, "node", "left").join(links, "node", "left")
    full = full.withColumn("component", F.coalesce("component", "node"))
    low = full.groupBy("component").agg(F.min("least").alias("component_id"))
    full = stored(full.join(low, "component").select("node", "again", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "ed-full")
    out = join_counted(named.select("id", "node", "again"), full, ["node", "again"], full.count(), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embed_dups(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
