"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments. Two codes that differ in at most ``m * (s + 1) - 1`` of their bits differ in at
most ``s`` bits of one of their ``m`` segments, so once every segment has been searched out to radius
``s``, all codes up to that distance have been seen. The radius grows until the k-th verified
distance is within what is covered; only then is a query done, so answers are exact.

A code that comes up in several segments and radii is verified once: where its segments differ least, in
the first of equal ones. What is farther than the k-th best so far is dropped at once.

The index is dealt by hash to blocks of bounded size, and the stated queries come in blocks too, more and
smaller ones while the index has few blocks:
each pair of blocks is one task, whose answers are merged by taking the k best of each query.
Equal codes of a block are one entry with its k smallest ids, so a very common code costs nothing.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import table
from edgeloom.session import stored

#: Rows of an index block and of a query block, which bound a task's memory.
INDEX_ROWS, QUERY_ROWS = 200_000, 20_000
#: Query blocks are made smaller, down to LEAST_ROWS, until there are as many pairs of blocks as shuffle partitions.
LEAST_ROWS = 250
#: Candidates verified at once.
CHUNK = 1 << 18


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def cuts(bits: int, rows: int) -> list[tuple[int, int]]:
    """Segments of about 0.6 times the logarithm of the rows, at most 16 bits each: many small flips cost more than longer lists."""
    m = max(1, -(-bits // 16), round(bits / max(1.0, 0.6 * np.log2(max(2, rows)))))
    m = min(m, bits)
    at = [i * bits // m for i in range(m + 1)]
    return list(zip(at, at[1:]))


def segment(words: np.ndarray, a: int, b: int) -> np.ndarray:
    """Bits ``a`` to ``b`` of packed codes as numbers."""
    out = words[:, a // 64] >> np.uint64(a % 64)
    if a // 64 != (b - 1) // 64:
        out = out | words[:, a // 64 + 1] << np.uint64(64 - a % 64)
    return (out & np.uint64((1 << (b - a)) - 1)).astype(np.int64)


def search(codes: np.ndarray, queries: np.ndarray, bits: int, k: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the codes that hold its k nearest rows: (query, code, distance).

    ``codes`` are distinct; ``weight`` is how many rows a code stands for, up to k. All codes
    as near as the k-th row are returned.
    """
    parts = cuts(bits, len(codes))
    m = len(parts)
    own = np.stack([segment(codes, a, b) for a, b in parts])
    asked = np.stack([segment(queries, a, b) for a, b in parts])
    order = [np.argsort(v, kind="stable") for v in own]
    start = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << (b - a)))]) for v, (a, b) in zip(own, parts)]
    enough = min(k, int(weight.sum()))
    limit = np.full(len(queries), bits)  # the k-th distance so far
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    open_ = np.arange(len(queries))
    for s in range(max(b - a for a, b in parts) + 1):
        for j, (a, b) in enumerate(parts):
            if s > b - a or not len(open_):
                continue
            fresh = [kept]
            for flips in combinations(range(b - a), s):
                want = asked[j][open_] ^ sum(1 << f for f in flips)
                lo, many = start[j][want], start[j][want + 1] - start[j][want]
                ends = np.cumsum(many)
                i = 0
                while i < len(open_) and ends[-1]:
                    e = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK)))
                    n = many[i:e]
                    if n.sum():
                        c = np.cumsum(n)
                        q, c = np.repeat(open_[i:e], n), order[j][np.repeat(lo[i:e] - c + n, n) + np.arange(c[-1])]
                        d = np.bitwise_count(codes[c, 0] ^ queries[q, 0]).astype(np.int64)
                        for w in range(1, codes.shape[1]):
                            d += np.bitwise_count(codes[c, w] ^ queries[q, w])
                        near = d <= limit[q]
                        q, c, d = q[near], c[near], d[near]
                        new = np.ones(len(q), bool)  # no segment differs less, no earlier one as little
                        for i2 in range(m):
                            if i2 != j:
                                gap = np.bitwise_count(own[i2][c] ^ asked[i2][q])
                                new &= gap > s if i2 < j else gap >= s
                        fresh.append((q[new], c[new], d[new]))
                    i = e
                if sum(len(x[0]) for x in fresh[1:]) > CHUNK:
                    fresh = [_nearest(fresh, limit, weight, enough)]
            kept = _nearest(fresh, limit, weight, enough)
        # what is covered holds the k-th row: no query needs to look farther
        q, c, d = kept
        near = d <= m * (s + 1) - 1
        seen = np.bincount(q[near], weight[c[near]], len(queries))
        open_ = open_[seen[open_] < enough]
        if not len(open_):
            break
    return kept


def _nearest(found: list[tuple], limit: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What is known without codes beyond the k-th row of their query; ``limit`` is brought down to that row's distance."""
    q, c, d = (np.concatenate(x) for x in zip(*found))
    if not len(q):
        return q, c, d
    order = np.lexsort((d, q))
    q, c, d = q[order], c[order], d[order]
    run = np.cumsum(weight[c])
    start = np.flatnonzero(np.diff(q, prepend=-1))
    before = np.repeat(run[start] - weight[c[start]], np.diff(start, append=len(q)))
    full = run - before >= k
    np.minimum.at(limit, q[full], d[full])
    keep = d <= limit[q]
    return q[keep], c[keep], d[keep]


def sign_bits(vector: str = "embedding"):
    """Bits of a vector: which of its components are positive; null for a vector that is null or empty or has a null or NaN component."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e))
    return F.when(fine, F.transform(v, lambda e: e > 0))


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", bits: str = "bits") -> DataFrame:
    """``query_id``, ``rank``, ``key`` and ``distance``: the k rows of ``index`` nearest to each query by Hamming distance.

    Equal distances are ranked by key, and rows that repeat a key are found as often. A query that is also in the index
    finds itself; of queries that repeat a key the one with the smallest bits is asked. Rows and queries whose bits are null, or of another length than the query's, are
    neither asked nor found; with fewer than k rows all are returned; empty tables give an
    empty one; other columns are not carried.
    """
    rows = stored(index.where(F.col(bits).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(bits).alias("bits")), "hk-index")
    asked = queries.where(F.col(bits).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(bits).alias("bits"))
    asked = stored(asked, "hk-queries")
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, n = max(1, -(-rows.count() // INDEX_ROWS)), asked.count()
    ways = max(1, -(-n // QUERY_ROWS), min(-(-n // LEAST_ROWS), tasks // blocks))
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.withColumn("asks", F.lit(False)).withColumn("i", place(blocks, 1)).withColumn("j", every(ways))
    b = asked.withColumn("asks", F.lit(True)).withColumn("j", place(ways, 2)).withColumn("i", every(blocks))

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids = t.column("id").fill_null(-(1 << 62)).to_numpy()
        width = int(t.column("bits")[0].values.__len__())
        words = packed(t.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        order = np.flatnonzero(~asks)
        ask = np.flatnonzero(asks)
        if not len(order) or not len(ask):
            return _answers([], [], [])
        order = order[np.argsort(ids[order], kind="stable")]
        codes, group = np.unique(words[order], axis=0, return_inverse=True)
        group = group.reshape(-1)
        by = np.argsort(group, kind="stable")  # ids ascend in each group
        many = np.bincount(group)
        start = np.cumsum(many) - many
        weight = np.minimum(many, k)
        q, c, d = search(codes, words[ask], width, k, weight)
        w = weight[c]
        e = np.cumsum(w)
        row = order[by[np.repeat(start[c] - e + w, w) + np.arange(e[-1] if len(e) else 0)]]
        q, d = np.repeat(q, w), np.repeat(d, w)
        best = np.lexsort((ids[row], d, q))
        q, d, row = q[best], d[best], row[best]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        keep = rank < k
        return _answers(ids[ask[q[keep]]], ids[row[keep]], d[keep])

    both = a.unionByName(b).repartition(min(blocks * ways, 8 * tasks), "i", "j")  # few bytes, much work: not to be merged
    near = both.groupBy("i", "j", F.size("bits").alias("w")).applyInArrow(run, "query_id long, id long, distance int")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    out = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "distance")


def _answers(q, i, d) -> pa.Table:
    null = -(1 << 62)
    ids = lambda x: pa.array([None if y == null else y for y in map(int, x)], pa.int64())
    return pa.table([ids(q), ids(i), pa.array(np.asarray(d, np.int32))], ["query_id", "id", "distance"])


def op9_hamming_topk(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sign_bits().alias("bits"))
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN e > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e))) = 0
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM v AS q JOIN v ON len(q.bits) = len(v.bits) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
