"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, neighbouring pairs and pairs with one or two words between, in
lower case, and words cut to STEMS code points, so that a stem is known from few of its forms; all are hashed to DIMS
coordinates. L1 leaves few weights, which every executor holds; whole texts are scored, each by itself.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fold, give_back, table, texts
from edgeloom.llm.ftrl import Ftrl, dense

#: Hashed coordinates.
DIMS = 1 << 20
#: The bound of the sample that the model is fitted on: labelled documents of class 0 and of class 1.
SAMPLE = (3000, 2000)
#: Lengths that longer words are cut to.
STEMS = (5, 6)
_words = re.compile(r"[^\W_]+").findall


class _Words(dict):
    """Words to places in ``hashes``: the checksum of the word and of its stems (0 for none); emptied at a bound."""

    most = 200_000

    def __init__(self):
        self.hashes = np.zeros((self.most, 1 + len(STEMS)), np.uint32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        raw = word.encode("utf-8", "surrogatepass")
        self.hashes[at] = zlib.crc32(raw), *[zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) if len(word) > k else 0 for k in STEMS]
        return at


_known = _Words()


def grams(text: str) -> np.ndarray:
    """Hashed coordinates of a text's words, pairs, skip pairs and stems; repeats stay."""
    words = _words(text.lower())
    if len(_known) + len(words) > _known.most:
        _known.clear()
        if len(words) > _known.most:  # a text of more words than are kept is taken in parts, which share the words around the cuts
            step = _known.most // 2
            return np.concatenate([_hashed(words[i : i + step + 3]) for i in range(0, len(words), step)])
    return _hashed(words)


def _hashed(words: list[str]) -> np.ndarray:
    if len(_known) + len(words) > _known.most:
        _known.clear()
    rows = _known.hashes[np.fromiter(map(_known.__getitem__, words), np.int64, len(words))].astype(np.uint64)
    h, stems = rows[:, 0], rows[:, 1:].ravel()
    parts = [h, stems[stems > 0]]
    for gap, by in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        parts.append((h[:-gap] * np.uint64(by) ^ h[gap:]) + np.uint64(gap) if len(h) > gap else h[:0])
    x = np.concatenate(parts) * np.uint64(0x9FB21C651E98DF25)
    return (x >> np.uint64(44)).astype(np.int32)


def _gram_lists(column: pa.Array) -> pa.Array:
    return pa.array([np.unique(grams(t)) for t in texts(column)], pa.list_(pa.int32()))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE, passes: int = 4) -> tuple:
    """Coordinates, weights and bias, learned from at most ``sample`` labelled rows of the classes.

    Rows of fold 0 and rows without a label teach nothing. Without rows of both classes the
    model has no weights and its bias is the class there is (or 0.5). The rarer class counts for more, by the
    root of the classes' ratio in the sample.
    """
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    pick = None
    for y in (0, 1):
        part = taught.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample[y])
        pick = part if pick is None else pick.unionByName(part)
    lists = F.arrow_udf(_gram_lists, "array<int>")
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), lists("text").alias("x")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    y = rows.column("y").to_pylist()
    model = Ftrl(DIMS, alpha=1.0, l1=24.0, l2=0.01)
    if len(set(y)) == 2:
        x = rows.column("x").combine_chunks()
        flat, ends = x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()
        keep = np.bincount(flat, minlength=DIMS)[flat] > 1  # what one document has can't pass L1 in these passes
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        flat = flat[keep]
        model.fit([(flat[a:b], np.ones(b - a)) for a, b in zip(ends, ends[1:])], y, passes, weights={1: (y.count(0) / y.count(1)) ** 0.5})
        found, w, bias = model.weights()
        return found, w, float(bias[0])
    bias = 0.0 if not y else (6.0 if y[0] else -6.0)
    return np.empty(0, np.int32), np.empty((0, 1), np.float32), bias


def scored(docs: DataFrame, model: tuple, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null or empty text has no features and gets the score of the bias. Rows are scored one by one, so
    repeated rows agree; an empty table stays empty; columns that have the new names are replaced.
    """
    found, w, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((found, w))
    held: dict = {}

    def rate(column: pa.Array) -> pa.Array:
        if "w" not in held:
            held["w"] = dense(DIMS, *sent.value)[:, 0]
        w = held["w"]
        out = np.empty(len(column))
        for i, t in enumerate(texts(column)):
            x = grams(t)
            x = np.unique(x[w[x] != 0])
            out[i] = bias + float(w[x].sum(dtype=np.float64))
        give_back()
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -40, 40))))

    out = docs.select(*[c for c in docs.columns if c not in (score, predicted)])
    out = out.withColumn(score, F.arrow_udf(rate, "double")(F.col(text)))
    return out.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def op7_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
