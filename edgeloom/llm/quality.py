"""Document quality by hierarchical empirical Bayes.

A logistic model of the text alone gives every document its evidence: the log odds of good
quality, less the log odds of the whole corpus. Hosts have a rate of good documents with a Beta
prior around the corpus rate, paths of a host one around the host's rate; how strong the
priors are is estimated by moments from how much hosts, and paths within hosts, differ
beyond chance. A document's posterior odds are its evidence times the odds of its path, with the
document's own part left out of its site's sums, so that a site of one document shrinks to its
host and a small host to the corpus.

Everything per site is a grouped sum, partially summed before it is shuffled; the table of sites is
counted before it is joined back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fold, fresh, give_back, held_columns, table, texts
from edgeloom.session import join_counted, stored

#: The bound of the sample that the text model is fitted on: labelled documents.
SAMPLE = 20_000
#: Prior strengths are kept between these numbers of documents.
STRENGTH = (1.0, 1e4)
_letters = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kind[b] = 0 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c == "\n" else 6 if b < 32 or b == 127 else 7 if c in ".,;:'\"?-()" else 8 if c in "|<>[]{}\\/_=+~^`" else 9 if c == "!" else 10
    return kind


_KIND = _classes()
#: Numbers that describe a text.
FEATURES = 22


def features(text: str) -> np.ndarray:
    """Shares of byte classes, word and line shapes, and how much of the text repeats."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_KIND, weights=np.bincount(b, minlength=256), minlength=11) / max(1, len(b))
    words = text.split()
    lines = text.split("\n")
    n = max(1, len(words))
    mean = (len(text) - n + 1) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    ends = sum(not w[-1].isalnum() for w in words) / n
    return np.array([*np.sqrt(share), np.log1p(len(words)), np.log1p(mean), len(set(words)) / n, len(set(lines)) / len(lines), same, ends, np.log1p(len(lines)), float(not words), np.log1p(n / len(lines)), share[2] / (share[1] + share[2] + 1e-9), 1.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; rows of ``x`` have a constant last."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(y)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights, learned from at most ``sample`` labelled rows, in hash order of their ids.

    Rows of fold 0 and without a label teach nothing; with no labelled row the weights are 0
    and every document is as likely good as not.
    """
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    pick = taught.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(sample)
    x = F.arrow_udf(lambda c: pa.array([features(t) for t in texts(c)], pa.list_(pa.float64())), "array<double>")
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), x("text").alias("x")).toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    if not len(rows):
        return np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES)
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("y").to_numpy().astype(float)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    centre[-1], scale[-1] = 0.0, 1.0
    return centre, scale, logistic((x - centre) / scale, y)


def _strength(rates: DataFrame) -> float:
    """Documents a prior counts for, by moments, from (n, s, q, mean): sizes, sums, sums of p * (1 - p), and the parent's mean.

    Between-site variance is the squared distance of site means from the parent's, less what
    chance gives; no more than chance means the strongest prior.
    """
    r = rates.where("n > 1").agg(
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("mean")) ** 2).alias("spread"),
        F.sum(F.col("mean") * (1 - F.col("mean"))).alias("chance"),
        F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))).alias("unit"),
        F.sum("n").alias("n"),
    ).first()
    if not r["n"] or not r["unit"]:
        return STRENGTH[1]
    between = (r["spread"] - r["chance"]) / r["n"]
    within = r["unit"] / r["n"]
    return float(min(max(within / between - 1, STRENGTH[0]), STRENGTH[1])) if between > 0 else STRENGTH[1]


def judged(docs: DataFrame, model: tuple, host: Column, path: Column, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``evidence``, ``host_rate``, ``path_rate``, ``score`` (probability of good quality) and ``kept`` (score >= 0.5).

    ``carry`` names the columns that stay, all of them by default; texts are scored once and written with these.
    Null hosts are one host, null paths one path of their host. A null or empty text has the evidence that
    the model gives to no words. Rows are judged one by one given their site, so repeated rows
    agree; an empty table stays empty; columns that have the new names are replaced.
    """
    centre, scale, w = model
    new = ["evidence", "host_rate", "path_rate", "score", "kept"]

    def odds(column: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in texts(column)]).reshape(-1, FEATURES)
        give_back()
        return pa.array(np.clip(((x - centre) / scale) @ w, -15, 15))

    kept = [c for c in (docs.columns if carry is None else carry) if c not in new]
    site, z, found = fresh(docs, "site", "z", "found")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    base = docs.select(*kept, F.struct(name(host).alias("host"), name(path).alias("path")).alias(site), F.arrow_udf(odds, "double")(F.col(text)).alias(z))
    base = stored(base, "eb-judged")
    p = 1 / (1 + F.exp(-F.col(z)))
    sites = stored(base.groupBy(F.col(site)["host"].alias("host"), F.col(site)["path"].alias("path")).agg(F.count("*").alias("n"), F.sum(p).alias("s")), "eb-sites")
    total = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("sites")).first()
    rate = min(max((total["s"] or 0.0) / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    hosts = stored(sites.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "eb-hosts")
    k_host = _strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s"), F.lit(rate).alias("mean")))
    hosts = hosts.withColumn("hr", (F.lit(k_host * rate) + F.col("hs")) / (F.lit(k_host) + F.col("hn")))
    both = stored(join_counted(sites, hosts, ["host"], hosts.count()), "eb-both")
    k_path = _strength(both.select("n", "s", F.col("hr").alias("mean")))
    both = both.select(F.struct("host", "path").alias(site), F.struct("n", "s", "hn", "hs").alias(found))
    out = join_counted(base, both, [site], total["sites"])
    at = F.col(found)
    host_rate = (F.lit(k_host * rate) + at["hs"] - p) / (F.lit(k_host) + at["hn"] - 1)
    path_rate = (F.lit(k_path) * host_rate + at["s"] - p) / (F.lit(k_path) + at["n"] - 1)
    within = lambda r: F.least(F.greatest(r, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = out.select(*kept, (F.col(z) - F.lit(float(np.log(rate / (1 - rate))))).alias("evidence"), within(host_rate).alias("host_rate"), within(path_rate).alias("path_rate"))
    out = out.withColumn("score", 1 / (1 + F.exp(-F.col("evidence") - F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    return out.withColumn("kept", F.col("score") >= 0.5)


def op10_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = judged(docs, fitted(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"), carry=["doc_id"])
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "score", "kept")


def stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents more likely good than not stay. The documents have no URL: host is the source, path the language.

    A null or empty text is judged by the site and by having no words; equal rows of a site stay or go together; an
    empty table stays empty.
    """
    held = held_columns(docs)
    docs = docs.select(*held)
    out = judged(docs, fitted(docs, table(spark, sf_dir, "labels")), F.col("source"), F.col("lang"))
    return out.where("kept").select(*held)
