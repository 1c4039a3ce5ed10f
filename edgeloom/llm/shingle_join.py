"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Documents are sets of word shingles, and two are linked when ``den * |A and B| >= num * |A or B|``.
Steps, each of which loses no link:

1. Documents with one set are one node, named by a 128-bit hash of the set, so copies are never paired.
   Half of the name is the node's id; sets whose halves meet take the other half.
2. A linked document shares at least ``num / den`` of its own shingles with another node. A shingle
   that two nodes of one batch have is counted there and sent on once, however common it is. Others are dealt
   by hash to buckets, 4 bytes each, and a bucket tells each node how many of its
   shingles there stand in a second node too. Nodes with too few shared ones leave here; a set that
   stands in several batches may be counted too high, never too low.
3. The rest order their shingles by document frequency, rarest first. Linked nodes share one of
   the first ``n - ceil(n * num / den) + 1``; the short inverted lists of these give, as chains
   ordered by size, the candidate groups (components of the chains). A long list is cut by a hash of the
   node into lists of about LIST nodes, each gives runs without a gap in size, and the runs are chained.
4. A candidate group is searched by T-occurrence: every node is a query over the smaller nodes
   before it. The ``L`` longest of its lists are set aside, the short ones are merged and keep
   nodes that occur ``T - L`` times, and these are probed by binary search in the long ones.
   Nodes known to be in the query's component need no search, which keeps large groups of near
   copies from being paired one by one. Groups above GROUP_SHINGLES are cut, in order of size,
   into blocks, and all pairs of blocks with compatible sizes are searched.
5. Components of the links.

Nothing is sampled or capped. Words and shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import WordHashes, give_back, held_columns, mix, slices, small_batches, table, texts
from edgeloom.operators.components import components
from edgeloom.operators.order import running
from edgeloom.session import dropped, join_counted, stored

#: Shingles per bucket of step 2 and per block of step 4, which bound a task's memory.
BUCKET_SHINGLES = 600_000
GROUP_SHINGLES = 800_000
#: Nodes of an inverted list that are put in order together.
LIST = 10_000
#: Weight of a merge step against a probe in the choice of L.
MU = 0.0085


def shingler(words: int) -> Callable[[str], np.ndarray]:
    """A function from a text to its set of shingles, as sorted distinct 64-bit hashes."""
    remembered = WordHashes()

    def shingles(text: str) -> np.ndarray:
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(remembered.__getitem__, tokens), np.uint64, len(tokens))
        k = min(words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    return shingles


def _name(s: np.ndarray, clash: frozenset[int] = frozenset()) -> tuple[int, int]:
    """The id of a set and the other half of its name, as signed integers; ids in ``clash`` stand for several sets."""
    name = xxhash.xxh3_128_intdigest(s.tobytes())
    node, again = ((x ^ 1 << 63) - (1 << 63) for x in (name >> 64, name & 0xFFFFFFFFFFFFFFFF))
    return (again if node in clash else node), again


def _sets(text_index: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]]:
    def read(batches):
        shingles = shingler(words)
        for whole in batches:
            for batch in slices(whole, text_index):
                yield batch, [shingles(t) for t in texts(batch.column(text_index))]
        shingles = None
        give_back()

    return read


def _nodes(words: int):
    """(doc_id, text) to (doc_id, n, node, again): the size and the name of the set; no name without words."""
    read = _sets(1, words)

    def run(batches):
        for batch, sets in read(batches):
            names = [_name(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)]], ["doc_id", "n", "node", "again"])

    return run


def _packed(key: np.ndarray, keys: int, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The keys that occur, and for each the bytes of its part of every column."""
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(keys + 1))
    full = np.flatnonzero(np.diff(edges))
    return full, [pa.array([c[order[edges[i] : edges[i + 1]]].tobytes() for i in full], pa.binary()) for c in columns]


def _buckets(words: int, buckets: int, clash: frozenset[int]):
    """(text) to (bucket, nodes, counts, marks, common): the shingles of one batch's nodes by buckets.

    ``common`` are marks that several nodes of the batch have; how many of those each node has is told under
    the bucket ``-1 - slot`` of the node.
    """
    read = _sets(0, words)
    names_ = ["bucket", "nodes", "counts", "marks", "common"]

    def run(batches):
        for _, sets in read(batches):
            kept = {_name(s, clash)[0]: s for s in sets if len(s)}
            if not kept:
                continue
            names = np.fromiter(kept, np.int64, len(kept))
            all_ = np.concatenate(list(kept.values()))
            owner = np.repeat(np.arange(len(names), dtype=np.int32), [len(s) for s in kept.values()])
            order = np.argsort(all_)
            starts = np.flatnonzero(np.diff(all_[order], prepend=all_[order[:1]] ^ np.uint64(1)))
            many = np.diff(starts, append=len(order))
            local = np.zeros(len(all_), bool)
            local[order] = np.repeat(many > 1, many)
            told = np.bincount(owner[local], minlength=len(names)).astype(np.int32)
            where = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            low = lambda x: (x & np.uint64(0xFFFFFFFF)).astype(np.uint32)

            own, one = owner[~local], all_[~local]
            place = where(one)
            by = np.argsort(place, kind="stable")
            own, one, place = own[by], one[by], place[by]
            edges = np.searchsorted(place, np.arange(buckets + 1))
            common = all_[order[starts[many > 1]]]
            hot = np.searchsorted(where(common), np.arange(buckets + 1))  # ascending, as the shingles are
            rows: list[tuple] = []
            for b in np.flatnonzero(np.diff(edges) + np.diff(hot)):
                mine = own[edges[b] : edges[b + 1]]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                rows.append((int(b), names[mine[first]].tobytes(), np.diff(first, append=len(mine)).astype(np.int32).tobytes(), low(one[edges[b] : edges[b + 1]]).tobytes(), low(common[hot[b] : hot[b + 1]]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)]], names_)
            some = told > 0
            full, (nodes, counts) = _packed(names[some] % buckets, buckets, names[some], told[some])
            none = pa.array([b""] * len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((-1 - full).astype(np.int32)), nodes, counts, none, none], names_)

    return run


def _shared(slots: int):
    """A bucket to (slot, nodes, counts): how many shingles of each node there another node has too, packed by slots of nodes."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        names, counts = _bytes(t, "nodes", np.int64), _bytes(t, "counts", np.int32)
        if bucket >= 0:
            node = np.repeat(names, counts)
            mark = _bytes(t, "marks", np.uint32)
            names, node = np.unique(node, return_inverse=True)
            pair = np.unique(mark.astype(np.uint64) << np.uint64(32) | node.astype(np.uint64))
            mark, node = pair >> np.uint64(32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = mark[1:] == mark[:-1]
            shared = np.zeros(len(mark), bool)
            shared[1:] |= same
            shared[:-1] |= same
            common = np.unique(_bytes(t, "common", np.uint32)).astype(np.uint64)
            if len(common):
                shared |= common[np.minimum(np.searchsorted(common, mark), len(common) - 1)] == mark
            counts = np.bincount(node[shared], minlength=len(names)).astype(np.int32)
            names, counts = names[counts > 0], counts[counts > 0]
        full, packed = _packed(names % slots, slots, names, counts)
        give_back()
        return pa.table([pa.array(full.astype(np.int32)), *packed], ["slot", "nodes", "counts"])

    return run


def _summed(t: pa.Table) -> pa.Table:
    """A slot to (node, shared)."""
    names, node = np.unique(_bytes(t, "nodes", np.int64), return_inverse=True)
    count = np.bincount(node, _bytes(t, "counts", np.int32), len(names)).astype(np.int64)
    return pa.table([pa.array(names), pa.array(count)], ["node", "shared"])


def _bytes(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(column).to_pylist()), kind)


def _rows(words: int, clash: frozenset[int]):
    """(node, text) to (node, n, shingles): the set itself, as bytes, where the set has that name; a null node takes any set."""
    read = _sets(1, words)

    def run(batches):
        for batch, sets in read(batches):
            rows = [(name, s) for node, s in zip(batch.column(0).to_pylist(), sets) if len(s) and ((name := _name(s, clash)[0]) == node or node is None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())], ["node", "n", "shingles"])

    return run


def _each(batches):
    """(node, n, shingles) to (shingle, node, n)."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        many = [len(s) for s in sets]
        if sum(many):
            again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), again(0), again(1)], ["shingle", "node", "n"])


def t_occurrence(sets: list[np.ndarray], num: int, den: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of a list of sorted distinct sets.

    With ``left``, a mask, only pairs with one side in it and one outside it count.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(n)])
    own = [token[starts[i] : starts[i + 1]] for i in range(len(sets))]
    at = np.concatenate([[0], np.cumsum(np.bincount(token))])  # of each inverted list
    fill = np.zeros(len(at) - 1, np.int64)
    lists = np.empty(at[-1], np.int32)
    label = np.arange(len(sets))
    sizes = n[order]
    links: list[tuple[int, int]] = []

    def joined(x: int, y: int) -> bool:
        both = np.searchsorted(own[y], own[x])
        both = int((own[y][np.minimum(both, n[y] - 1)] == own[x]).sum())
        if den * both < num * (n[x] + n[y] - both):
            return False
        links.append((x, y))
        label[label == label[y]] = label[x]
        return True

    for r, x in enumerate(order):
        m, mine = int(n[x]), own[x]
        before = order[np.searchsorted(sizes, -(-num * m // den)) : r]  # smaller nodes of a compatible size
        if left is not None:
            before = before[left[before] != left[x]]
        if len(before):
            longs = fill[mine]
            by_length = np.argsort(longs, kind="stable")
            t = -(-num * m // den)
            skip = min(t - 1, int(t / (MU * np.log2(max(2, longs.max())) + 1)))
            short = mine[by_length[: m - skip]]
            short = short[fill[short] > 0]
            if len(short):  # one likely partner first: then a group of near copies is known at once
                y = int(lists[at[short[0]] + fill[short[0]] - 1])
                if den * n[y] >= num * m and (left is None or left[y] != left[x]):
                    joined(x, y)
            if len(short) and (label[before] != label[x]).any():
                many = fill[short]
                ends = np.cumsum(many)
                found = lists[np.repeat(at[short] - ends + many, many) + np.arange(ends[-1])]
                found = found[(n[found] * den >= num * m) & (label[found] != label[x])]
                if left is not None:
                    found = found[left[found] != left[x]]
                found, times = np.unique(found, return_counts=True)  # the merge
                for y in found[times >= t - skip][np.argsort(-times[times >= t - skip], kind="stable")]:
                    if label[y] != label[x]:
                        joined(x, int(y))  # the probes
        lists[at[mine] + fill[mine]] = x
        fill[mine] += 1
    return links


def _search(num: int, den: int):
    """One block: (part, side, node, shingles) to links (u, v). Parts are searched one by one."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        part = t.column("part").to_numpy()
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        raw = t.column("shingles")
        u, v = [], []
        edges = np.flatnonzero(np.diff(part, prepend=part[0] - 1)).tolist() + [len(part)]
        for a, b in zip(edges, edges[1:]):
            sets = [np.frombuffer(x, np.uint64) for x in raw[a:b].to_pylist()]
            two = side[a:b] > 0
            for x, y in t_occurrence(sets, num, den, two if two.any() else None):
                u.append(node[a + x])
                v.append(node[a + y])
        give_back()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def linked(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    A text's words are runs without ASCII white space, A-Z in lower case; its set is its distinct
    shingles of ``words`` words, or the whole sequence as one if it has fewer. Null, empty and blank
    texts have no shingles and are linked with nothing. ``component_id`` is the smallest key reachable
    by links, the row's own included. Rows that share a key but not a text are separate rows; repeated
    rows get the same answer; a null key counts only where its component has no other. Other
    columns are not carried; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    nodes = stored(base.mapInArrow(_nodes(words), "doc_id long, n long, node long, again long"), "nj-nodes")
    clash: frozenset[int] = frozenset()
    while True:
        reps = nodes.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id"), (F.min("again") != F.max("again")).alias("clash"))
        reps = stored(reps, "nj-reps")
        found = {r["node"] for r in reps.where("clash").select("node").collect()}  # by chance: n * n / 2 ** 65 of n sets
        if not found:
            break
        clash |= found
        nodes = stored(nodes.withColumn("node", F.when(F.col("node").isin(list(found)), F.col("again")).otherwise(F.col("node"))), "nj-nodes")
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SHINGLES))

    dealt = base.select("text").mapInArrow(_buckets(words, buckets, clash), "bucket int, nodes binary, counts binary, marks binary, common binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared(buckets), "slot int, nodes binary, counts binary")
    shared = shared.groupBy("slot").applyInArrow(_summed, "node long, shared long")
    alive = stored(reps.join(shared, "node").where(F.col("shared") * den >= F.col("n") * num).select("node", "doc_id"), "nj-alive")
    n_alive = alive.count()

    # a key tells the row of a set unless other sets have it too, or it is null: then the sets' own names do
    keys = alive.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.min("node")).alias("node"))
    keys = stored(keys.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))), "nj-keys")
    fetched = lambda rows: rows.select("node", "text").mapInArrow(_rows(words, clash), "node long, n long, shingles binary")
    sets = fetched(join_counted(base, keys.where("node is not null"), ["doc_id"], n_alive))
    if n_loose := keys.where("node is null").count():
        loose = join_counted(base, keys.where("node is null and doc_id is not null"), ["doc_id"], n_loose)
        loose = loose.unionByName(base.where("doc_id is null").withColumn("node", F.lit(None).cast("long")))
        sets = sets.unionByName(join_counted(fetched(loose), alive.select("node"), ["node"], n_alive))
    sets = stored(sets.dropDuplicates(["node"]), "nj-sets")
    each = sets.mapInArrow(_each, "shingle long, node long, n long")
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(often, "shingle").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    first = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.size("rare"))
    prefix = ordered.where(first > 0).select("node", "n", F.explode(F.slice("rare", F.lit(1), first.cast("int"))).alias("r"))
    prefix = prefix.select("node", "n", F.col("r.shingle").alias("shingle"), F.pmod(F.xxhash64("node"), F.ceil(F.col("r.df") / LIST)).alias("cut"))
    w = Window.partitionBy("shingle", "cut").orderBy("n", "node")
    gap = F.coalesce(F.lag("n").over(w) * den < F.col("n") * num, F.lit(True))
    chain = prefix.withColumn("other", F.lag("node").over(w)).withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("long")).over(w))
    chain = stored(chain, "nj-chain")
    links = chain.where("not gap").select(F.col("node").alias("u"), F.col("other").alias("v"))
    runs = chain.groupBy("shingle", "cut", "run").agg(F.min("n").alias("low"), F.max(F.struct("n", "node")).alias("top"))
    before = Window.partitionBy("shingle").orderBy("low", "top").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("reach", F.max("top").over(before)).where(F.col("reach.n") * den >= F.col("low") * num)
    links = links.unionByName(runs.select(F.col("top.node").alias("u"), F.col("reach.node").alias("v")))
    groups = stored(components(links.distinct()), "nj-groups")

    slim = stored(sets.select("node", "n").join(groups, "node"), "nj-slim")
    large = stored(slim.groupBy("component").agg(F.sum("n").alias("whole")).where(F.col("whole") > GROUP_SHINGLES).select("component"), "nj-large")
    if n_large := large.count():
        cut = running(join_counted(slim, large, ["component"], n_large), [F.col("component"), F.col("n"), F.col("node")], F.col("n").cast("double"), "pos", "cum")
        cut = cut.select("node", "n", "component", F.floor((F.col("cum") - F.col("n")) / GROUP_SHINGLES).alias("block"))
        rest = join_counted(slim, large.withColumn("is_large", F.lit(True)), ["component"], n_large, "left").where("is_large is null").select("node", "n", "component", F.lit(0).cast("long").alias("block"))
        slim = stored(cut.unionByName(rest), "nj-blocks")
    else:
        slim = slim.withColumn("block", F.lit(0).cast("long"))
    blocks = slim.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a = blocks.select("component", F.col("block").alias("i"), F.col("high"))
    b = blocks.select("component", F.col("block").alias("j"), F.col("low"))
    pairs = a.join(b, "component").where((F.col("i") <= F.col("j")) & (F.col("low") * num <= F.col("high") * den)).select("component", "i", "j")
    sides = pairs.select("component", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    sides = sides.select("component", "i", "j", "s.block", "s.side")
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(slim.agg(F.sum("n")).first()[0] or 0) // GROUP_SHINGLES))
    sizes = blocks.groupBy("component").agg((F.count("*") > 1).alias("large"))
    place = slim.join(sides, ["component", "block"]).join(sizes, "component")
    place = place.select("node", "side", F.xxhash64("component", "i", "j").alias("part"), F.when(F.col("large"), F.xxhash64("component", "i", "j")).otherwise(F.pmod("component", F.lit(bins))).alias("bin"))
    links = stored(place.join(sets.select("node", "shingles"), "node").groupBy("bin").applyInArrow(_search(num, den), "u long, v long"), "nj-links")
    joined = stored(components(links), "nj-joined")

    least = stored(
        reps.join(joined, "node").groupBy("component").agg(F.min("doc_id").alias("component_id")).join(joined, "component").select("node", "component_id"), "nj-least"
    )
    n_least = least.count()
    out = nodes.select("doc_id", "n", "node").join(reps.select("node", F.col("doc_id").alias("own")), "node", "left")
    out = join_counted(out, least, ["node"], n_least, "left")
    dropped(alive, keys, sets, chain, groups, large)
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "own", "doc_id").alias("component_id"))


def op3_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Of each component the document with the smallest id stays; of rows that repeat an id one, and no null id goes."""
    out = linked(docs.select("doc_id", "text"))
    kept = stored(out.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg((F.count("*") > 1).alias("again")), "nj-kept")
    stay = join_counted(docs.where("doc_id is not null"), kept, ["doc_id"], kept.count())
    held = held_columns(docs)
    once = stay.where("not again").unionByName(stay.where("again").dropDuplicates(["doc_id"])).select(*held)
    return once.unionByName(docs.where("doc_id is null").select(*held))
