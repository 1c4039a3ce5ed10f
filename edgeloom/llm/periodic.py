"""Periodic runs of words, found with Karp-Miller-Rosenberg names.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(6, 4 q)`` words that
no neighbouring word extends. Level ``k`` names every block of ``2^k`` words, so that two blocks of a document are equal
where their names are; a name of level ``k + 1`` is the name of a pair of level ``k``. A block with a half that
stands nowhere else stands nowhere else either and gets its name without being compared.

A run of period ``p`` has at least ``3 p`` places whose word returns ``p`` later, so some multiple of ``2 p``
is followed by ``p`` such places: these multiples are the grid of candidates, and a candidate passes if the blocks of the largest
``2^k <= p`` at both places have one name. What passes is extended to both sides by the names, from the
highest level down. Stretches found with several periods keep the smallest, which divides the others.

All documents of a batch, longest first, are laid end to end; words of different documents have different names, so
nothing crosses a border. Memory is about 4 bytes a word and level, with ``log2`` of the longest document levels.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fresh, give_back, slices, table

#: A run has at least LEAST words and TIMES of its period.
LEAST, TIMES = 6, 4
#: Candidates that are extended together.
TOGETHER = 1 << 20


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the pairs (a[i], b[i]): equal where and only where the pairs are."""
    n = len(a)
    many = np.bincount(a, minlength=1)[a] > 1
    many &= np.bincount(b, minlength=1)[b] > 1
    out = np.arange(n, dtype=np.int32)  # a block that stands once is named by its place
    at = np.flatnonzero(many)
    if len(at):
        key = a[at].astype(np.int64) << 32 | b[at]
        by = np.argsort(key, kind="stable")
        new = np.diff(key[by], prepend=-1) != 0
        out[at[by]] = at[by[np.flatnonzero(new)]][np.cumsum(new) - 1]
    return out


def _levels(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Names by level; level k is kept for the documents of at least 2^k words, which stand first."""
    ends = np.cumsum(lengths)
    levels = [words]
    k = 1
    while len(lengths) and lengths[0] >= 1 << k:
        reach = int(ends[np.searchsorted(-lengths, -(1 << k), side="right") - 1])
        below = levels[-1]
        half = 1 << (k - 1)
        n = min(reach, len(below) - half)
        levels.append(_paired(below[:n], below[half : half + n]))
        k += 1
    return levels


def _forwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    i, j = i.copy(), j.copy()
    done = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        open_ = np.flatnonzero(j < len(names))
        open_ = open_[names[i[open_]] == names[j[open_]]]
        while len(open_):  # the highest level may match more than once
            i[open_] += 1 << k
            j[open_] += 1 << k
            done[open_] += 1 << k
            if k < len(levels) - 1:
                break
            open_ = open_[j[open_] < len(names)]
            open_ = open_[names[i[open_]] == names[j[open_]]]
    return done


def _backwards(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    i, j = i.copy(), j.copy()
    done = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, size = levels[k], 1 << k
        fits = lambda x: x[(i[x] >= size) & (j[x] - size < len(names))]
        open_ = fits(np.arange(len(i)))
        open_ = open_[names[i[open_] - size] == names[j[open_] - size]]
        while len(open_):
            i[open_] -= size
            j[open_] -= size
            done[open_] += size
            if k < len(levels) - 1:
                break
            open_ = fits(open_)
            open_ = open_[names[i[open_] - size] == names[j[open_] - size]]
    return done


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document, as rows (start, length, period) by start, then period."""
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    if not len(order):
        return out
    lengths = sizes[order]
    ends = np.cumsum(lengths)
    ids: list[int] = []
    for d in order.tolist():  # words of different documents get different names
        names: dict[bytes, int] = defaultdict(lambda base=len(ids), seen=[]: (seen.append(0), base + len(seen) - 1)[1])
        ids += map(names.__getitem__, documents[d])
    levels = _levels(np.array(ids, np.int32), lengths)
    found, held, size = [], [], 0

    def extend():
        i, p = (np.concatenate(x) for x in zip(*held))
        back, on = _backwards(levels, i, i + p), _forwards(levels, i, i + p)
        start, length = i - back, back + on + p
        some = length >= np.maximum(LEAST, TIMES * p)
        found.append(np.unique(np.stack([start[some], length[some], p[some]], 1), axis=0))

    for p in range(1, int(lengths[0]) // TIMES + 1):
        reach = int(ends[np.searchsorted(-lengths, -TIMES * p, side="right") - 1])
        names = levels[p.bit_length() - 1]
        n = min(reach, len(names)) - p
        if n <= 0:
            break
        at = np.flatnonzero(names[0 : n : 2 * p] == names[p : p + n : 2 * p]) * (2 * p)
        if len(at):
            held.append((at, np.full(len(at), p)))
            size += len(at)
            if size >= TOGETHER:
                extend()
                held, size = [], 0
    if held:
        extend()
    if not found:
        return out
    runs = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    doc = np.searchsorted(ends, runs[:, 0], side="right")
    edges = np.searchsorted(doc, np.arange(len(order) + 1))
    for k in np.unique(doc).tolist():
        out[order[k]] = runs[edges[k] : edges[k + 1]] - [ends[k] - lengths[k], 0, 0]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


RUNS = "struct<runs: array<struct<start: long, length: long, period: long>>, kept: string>"


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", kept: str = "kept") -> DataFrame:
    """Adds ``runs`` (array of start, length, period; by start, then period) and ``kept`` (the words outside repetitions, one space between).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text and are numbered from 0. A null, empty or blank text has no
    runs and keeps the empty text. Each row is looked at by itself, so repeated rows, ties and null keys don't matter;
    an empty table stays empty; other columns stay, those that have the new names are replaced.
    """

    def search(column: pa.Array) -> pa.Array:
        got: list[np.ndarray] = []
        texts: list[bytes] = []
        for part in slices(pa.RecordBatch.from_arrays([column], ["t"]), 0):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column(0).to_pylist()]
            some = runs_of(words)
            got += some
            texts += [b" ".join(collapsed(w, r)) for w, r in zip(words, some)]
        offsets = np.zeros(len(got) + 1, np.int32)
        np.cumsum([len(r) for r in got], out=offsets[1:])
        flat = np.concatenate(got) if got else np.empty((0, 3), np.int64)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
        give_back()
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(texts, pa.binary()).cast(pa.string())], ["runs", "kept"])

    (both,) = fresh(docs, "searched")
    out = docs.withColumn(both, F.arrow_udf(search, RUNS)(F.col(text)))
    return out.select(*[c for c in docs.columns if c not in (runs, kept)], F.col(both)["runs"].alias(runs), F.col(both)["kept"].alias(kept))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The text that the query searches: one in ten documents, by the crc32 of its id, goes round in a loop at its end."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _with_loops(doc_id: pa.Array, text: pa.Array) -> pa.Array:
    out = [b" ".join(looped((t or "").encode("utf-8", "surrogatepass").split(), d)) for d, t in zip(doc_id.to_pylist(), text.to_pylist())]
    return pa.array(out, pa.binary()).cast(pa.string())


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    """Runs of every document after its loop is made; a null id makes no loop."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_runs(docs.withColumn("text", F.arrow_udf(_with_loops, "string")(F.col("doc_id").cast("long"), "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    milli = -1000 * best["l"]
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        ((milli - milli % best["p"]) / best["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
