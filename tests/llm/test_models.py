"""Language, toxicity and quality: held-out accuracy on made-up text, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import language, quality, toxicity
from edgeloom.llm.ftrl import Ftrl

LANGS = {"aa": "the of and to in is that for it was".split(), "bb": "der die und das ist nicht ein zu von mit".split(), "cc": "le la et les des que une dans est pour".split()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(420):
        lang = rng.choice(sorted(LANGS))
        words = [rng.choice(LANGS[lang]) + rng.choice(["", "n", "s"]) for _ in range(rng.randint(6, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "foulest"]))
        good = rng.random() < 0.7
        text = " ".join(words) if good else "### ".join(words) + " $$$ ||| %%%"
        rows.append((i, text, lang, f"s{i % 3}", len(text), int(good), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    return df.cache()


ODD = [(9001, None, None, None, 0), (9002, "", "aa", "s0", 0), (9003, "12 34 !?", "aa", "s0", 0), (None, "der die und", None, "s1", 0), (9004, "der und das " * 8000, "bb", "s1", 0), (9004, "der und das " * 8000, "bb", "s1", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark, docs):
    model = language.fitted(docs)
    out = language.identified(docs.withColumn("score", F.lit("clash")), model).toPandas()
    test = out[[held(i) for i in out.doc_id]]
    assert (test.lang_pred == test.lang).mean() > 0.95
    assert out.score.between(0, 1).all()
    odd = {(r["doc_id"], r["lang_pred"]) for r in language.identified(spark.createDataFrame(ODD, SCHEMA), model).collect()}
    assert {(9001, "und"), (9002, "und"), (9003, "und"), (None, "bb"), (9004, "bb")} == odd
    empty = spark.createDataFrame([], SCHEMA)
    none = language.fitted(empty)
    assert language.identified(empty, none).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, none).collect()} == {"und"}
    kept = language.stage(spark, docs.unionByName(spark.createDataFrame(ODD, SCHEMA), True), None)
    assert kept.where("doc_id in (9001, 9002, 9003)").count() == 0 and kept.where("doc_id < 9000").count() >= 410


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language.temperature(z * 4, y) - 4) < 0.5
    assert language.temperature(np.empty((0, 3)), np.empty(0, int)) == 1.0


def test_toxicity(spark, docs):
    labels = docs.select("doc_id", "toxic", "quality")
    model = toxicity.fitted(docs, labels, passes=6)
    out = toxicity.scored(docs, model).toPandas()
    test = out[[held(i) for i in out.doc_id]]
    assert (test.predicted == test.toxic).mean() > 0.95
    assert len(model[0]) < 400  # few weights remain
    odd = toxicity.scored(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in odd)
    none = toxicity.fitted(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_labels_of_the_held_out_teach_nothing(docs):
    labels = docs.select("doc_id", "toxic")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fitted(docs, labels), toxicity.fitted(docs, wrong)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 500, 20)) for _ in range(600)]
    y = [int(7 in r) for r in rows]
    m = Ftrl(500, alpha=1.0, l1=3.0, l2=0.01)
    m.fit([(r, np.ones(len(r))) for r in rows], y, 5)
    found, w, _ = m.weights()
    assert 7 in found and w[list(found).index(7), 0] == w.max() and len(found) < 100


def brute_quality(rows, z):
    """The whole posterior in plain Python, from evidence z by row."""
    p = 1 / (1 + np.exp(-z))
    hosts, paths = {}, {}
    for (h, q), x in zip(rows, p):
        for d, k in ((hosts, h), (paths, (h, q))):
            n, s = d.get(k, (0, 0.0))
            d[k] = n + 1, s + x
    rate = p.mean()

    def strength(groups):
        g = [(n, s, m) for n, s, m in groups if n > 1]
        unit = sum(n * m * (1 - m) for n, s, m in g)
        if not g or not unit:
            return quality.STRENGTH[1]
        total = sum(n for n, *_ in g)
        between = (sum(n * (s / n - m) ** 2 for n, s, m in g) - sum(m * (1 - m) for _, _, m in g)) / total
        return min(max(unit / total / between - 1, quality.STRENGTH[0]), quality.STRENGTH[1]) if between > 0 else quality.STRENGTH[1]

    kh = strength([(n, s, rate) for n, s in hosts.values()])
    mean = {h: (kh * rate + s) / (kh + n) for h, (n, s) in hosts.items()}
    kp = strength([(n, s, mean[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for (h, q), x, e in zip(rows, p, z):
        hn, hs = hosts[h]
        n, s = paths[h, q]
        hr = (kh * rate + hs - x) / (kh + hn - 1)
        pr = (kp * hr + s - x) / (kp + n - 1)
        out.append(1 / (1 + np.exp(-(e - np.log(rate / (1 - rate))) - np.log(pr / (1 - pr)))))
    return np.array(out)


def test_quality(spark, docs):
    model = quality.fitted(docs, docs.select("doc_id", "quality"))
    out = quality.judged(docs, model, F.col("source"), F.col("lang")).toPandas()
    test = out[[held(i) for i in out.doc_id]]
    assert (test.kept.astype(int) == test.quality).mean() > 0.95
    centre, scale, w = model
    z = np.clip(np.array([(quality.features(t) - centre) / scale @ w for t in out.text]), -15, 15)
    assert np.allclose(out.score, brute_quality(list(zip(out.source, out.lang)), z), atol=1e-6)
    odd = quality.judged(spark.createDataFrame(ODD, SCHEMA), model, F.col("source"), F.col("lang")).collect()
    assert len(odd) == 6 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.judged(spark.createDataFrame([], SCHEMA), model, F.col("source"), F.col("lang")).count() == 0
    blank = quality.fitted(docs, docs.select("doc_id", "quality").limit(0))
    assert quality.judged(docs, blank, F.col("source"), F.col("lang")).count() == 420


def test_language_equals_a_plain_scorer(docs):
    model = language.fitted(docs)
    weights = {int(i): row for i, row in zip(model["found"], model["w"])}

    def plain(text):
        codes = [ord(c) for c in text.lower()]
        grams = {}
        for k in range(len(codes)):
            one = codes[k] * 0x9E3779B1 & 0xFFFFFFFF
            two = (one ^ codes[k + 1]) * 0x85EBCA77 & 0xFFFFFFFF if k + 1 < len(codes) else None
            three = (two ^ codes[k + 2]) * 0xC2B2AE3D & 0xFFFFFFFF if k + 2 < len(codes) else None
            for x in (one, two, three):
                if x is not None:
                    grams[x >> 16] = grams.get(x >> 16, 0) + 1
        v = {i: (1 + np.log(n)) * model["idf"][i] for i, n in grams.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        z = np.array(model["bias"], float)
        for i, x in v.items():
            if i in weights:
                z = z + weights[i] * (x / size)
        p = np.exp(z / model["t"] - max(z / model["t"]))
        return model["langs"][int(p.argmax())], float(p.max() / p.sum())

    for r in language.identified(docs, model).collect()[:60]:
        lang, score = plain(r["text"])
        assert lang == r["lang_pred"] and abs(score - r["score"]) < 1e-4


def test_toxicity_equals_a_plain_scorer(docs):
    found, w, bias = model = toxicity.fitted(docs, docs.select("doc_id", "toxic"))
    weights = dict(zip(found.tolist(), w[:, 0].tolist()))
    mask = (1 << 64) - 1

    def plain(text):
        import re

        words = re.findall(r"[^\W_]+", text.lower())
        h = [zlib.crc32(x.encode()) for x in words]
        raw = set(h)
        for x in words:
            raw |= {zlib.crc32(x[:k].encode(), k) for k in toxicity.STEMS if len(x) > k}
        for gap, by in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
            raw |= {((a * by & mask) ^ b) + gap & mask for a, b in zip(h, h[gap:])}
        z = bias + sum(weights.get(i, 0.0) for i in {(x * 0x9FB21C651E98DF25 & mask) >> 44 for x in raw})
        return 1 / (1 + np.exp(-z))

    for r in toxicity.scored(docs, model).collect()[:80]:
        assert abs(plain(r["text"]) - r["score"]) < 1e-4


def test_a_text_of_more_words_than_are_kept(monkeypatch):
    text = " ".join(f"w{i}" for i in range(900))
    want = np.unique(toxicity.grams(text))
    small = toxicity._Words()
    small.most = 100
    monkeypatch.setattr(toxicity, "_known", small)
    assert (np.unique(toxicity.grams(text)) == want).all()


CLASH = ["n", "s", "hn", "hr", "site", "z", "found", "judged", "host", "path", "p", "whole", "c0", "c1", "h", "h2", "size_", "mix_source", "words", "run", "copy", "coded", "y", "x", "many", "u"]


def test_any_column_may_be_there(spark, docs):
    more = docs.drop("toxic", "quality").limit(60)
    for i, c in enumerate(CLASH):
        more = more.withColumn(c, F.lit(i))
    model = quality.fitted(docs, docs.select("doc_id", "quality"))
    out = quality.judged(more, model, F.col("source"), F.col("lang"))
    assert out.columns == more.columns + ["evidence", "host_rate", "path_rate", "score", "kept"] and out.count() == 60
    assert out.select(*CLASH).distinct().count() == 1 and out.first()["h2"] == CLASH.index("h2")
    assert language.identified(more, language.fitted(docs)).select(*CLASH).distinct().collect()[0]["judged"] == CLASH.index("judged")
    assert toxicity.scored(more, toxicity.fitted(docs, docs.select("doc_id", "toxic"))).columns == more.columns + ["score", "predicted"]
    from edgeloom.llm import mixing

    mixed = mixing.mixed(more)
    assert mixed.columns == more.columns + ["size", "source_size", "target", "times"] and mixed.select(*CLASH).distinct().count() == 1


def test_stages_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
