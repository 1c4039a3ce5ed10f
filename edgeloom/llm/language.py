"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three code points of the lower-case text are hashed to DIMS coordinates. Document
frequencies are counted over all documents that may be learned from; the model is fitted by
follow-the-regularised-leader with an elastic net on a bounded sample of them, and a
temperature is then fitted on the part of the sample that the model has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fold, fresh, give_back, held_columns, small_batches, table, texts, uniform
from edgeloom.llm.ftrl import Ftrl, dense
from edgeloom.session import join_counted, stored

#: Hashed coordinates.
DIMS = 1 << 16
#: The bounds of the sample that the model is fitted on: documents of each language and of all, in expectation.
SAMPLE, TOTAL = 1000, 20_000
#: The prediction for a text without a letter.
NONE = "und"
#: The pipeline rejects a document whose calibrated score is below this, or whose language is ``und``.
LEAST_SCORE = 0.4


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a text's grams, ascending, and how often each occurs."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    p = a * np.uint32(0x9E3779B1)
    pair = (p[:-1] ^ a[1:]) * np.uint32(0x85EBCA77)
    trio = (pair[:-1] ^ a[2:]) * np.uint32(0xC2B2AE3D) if len(a) > 2 else pair[:0]
    x = np.concatenate([p >> np.uint32(16), pair >> np.uint32(16), trio >> np.uint32(16)])
    if len(x) < 2000:
        return np.unique(x, return_counts=True)
    n = np.bincount(x, minlength=DIMS)
    i = np.flatnonzero(n)
    return i.astype(np.uint32), n[i]


def weighed(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's coordinates and its TF-IDF vector, of length 1; logarithmic in the counts."""
    i, n = counts(text)
    v = (1.0 + np.log(n)) * idf[i] if len(i) else np.empty(0)
    return i, v / max(1e-12, np.sqrt((v * v).sum()))


def _frequencies(batches):
    seen = np.zeros(DIMS, np.int64)
    for batch in batches:
        for t in texts(batch.column(0)):
            seen[counts(t)[0]] += 1
    i = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(seen[i])], ["gram", "df"])


def fitted(docs: DataFrame, sample: int = SAMPLE, passes: int = 4, held: bool = True) -> dict:
    """The model: idf, languages, weights, bias and temperature.

    Learns from text and ``lang`` where neither is null, and with ``held`` only outside fold 0. Without
    such rows it has no language and predicts ``und`` with score 0.
    """
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = taught.where(fold(F.col("doc_id")) != 0) if held else taught
    taught = taught.select("doc_id", "lang", "text")
    idf = np.zeros(DIMS)
    n = taught.count()
    for r in taught.select("text").mapInArrow(_frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        idf[r["gram"]] = r["df"]
    idf = np.log((1.0 + n) / (1.0 + idf)) + 1.0
    each = stored(taught.groupBy("lang").agg(F.count("*").alias("many")), "lang-counts")
    sent = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def vectors(column: pa.Array) -> pa.Array:
        rows = [weighed(t, sent.value) for t in texts(column)]
        ids = pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([ids, pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["i", "v"])

    u = uniform(F.col("doc_id"), F.col("text"), seed=11)
    n_langs = each.count()
    pick = join_counted(taught, each, ["lang"], n_langs).where(u * F.col("many") < min(float(sample), TOTAL / max(1, n_langs)))
    rows = pick.select("lang", u.alias("u"), F.arrow_udf(vectors, "struct<i: array<int>, v: array<float>>")("text").alias("x")).toArrow().sort_by([("u", "ascending"), ("lang", "ascending")])
    langs = sorted(set(rows.column("lang").to_pylist()))
    if not langs:
        return {"idf": idf, "langs": [], "found": np.empty(0, np.int32), "w": np.empty((0, 1), np.float32), "bias": np.zeros(1), "t": 1.0}
    x = rows.column("x").combine_chunks()
    vec = [(np.array(i), np.array(v)) for i, v in zip(x.field("i").to_numpy(zero_copy_only=False), x.field("v").to_numpy(zero_copy_only=False))]
    y = [langs.index(v) for v in rows.column("lang").to_pylist()]
    part = np.arange(len(y)) % 5 == 4
    model = Ftrl(DIMS, max(2, len(langs)), alpha=1.0, l1=0.02, l2=0.02)
    model.fit([v for v, p in zip(vec, part) if not p], [v for v, p in zip(y, part) if not p], passes)
    found, w, bias = model.weights()
    table_ = dense(DIMS, found, w)
    logits = np.array([v @ table_[i] + bias for (i, v), p in zip(vec, part) if p]).reshape(-1, len(bias))
    return {"idf": idf, "langs": langs, "found": found, "w": w, "bias": bias, "t": temperature(logits, np.array([v for v, p in zip(y, part) if p], int))}


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(s: float) -> float:
        z = logits / np.exp(s)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def identified(docs: DataFrame, model: dict, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the calibrated probability of that language.

    A null text, and one without a letter, is ``und`` with score 0. Equal probabilities go to
    the language that sorts first. Rows are judged one by one, so repeated rows agree; an empty
    table stays empty; columns that have the new names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def judge(column: pa.Array) -> pa.Array:
        m = sent.value
        if "w" not in held:
            held["w"] = dense(DIMS, m["found"], m["w"])
        langs, scores = [], []
        for t in texts(column):
            if not m["langs"] or not any(map(str.isalpha, t)):
                langs.append(NONE)
                scores.append(0.0)
                continue
            i, v = weighed(t, m["idf"])
            z = ((v.astype(np.float32) @ held["w"][i]).astype(float) + m["bias"])[: len(m["langs"])] / m["t"]
            p = np.exp(z - z.max())
            k = int(p.argmax())
            langs.append(m["langs"][k])
            scores.append(float(p[k] / p.sum()))
        give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    kept = [c for c in docs.columns if c not in (pred, score)]
    (both,) = fresh(docs, "judged")
    out = docs.withColumn(both, F.arrow_udf(judge, "struct<lang: string, score: double>")(F.col(text)))
    return out.select(*kept, F.col(both)["lang"].alias(pred), F.col(both)["score"].alias(score))


def op4_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs, fitted(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents with a language, told with at least LEAST_SCORE, stay; null texts and texts without a letter go.

    Rows are judged one by one, so repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(spark)
    held = held_columns(docs)
    out = identified(docs.select(*held), fitted(docs))
    return out.where((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE)).select(*held)
