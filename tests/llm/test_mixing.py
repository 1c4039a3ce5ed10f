from edgeloom.llm.mixing import mixed, stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, times string"


def mix(spark, rows, **o):
    return mixed(spark.createDataFrame(rows, SCHEMA), **o)


def brute(sizes: dict, weights, share=1.5, epochs=2.0):
    """Targets by clamping and dealing again, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped, out = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(epochs * sizes[s] for s in capped)
        out = {s: epochs * sizes[s] for s in capped} | {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if out[s] > epochs * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_and_words_taken(spark):
    rows = [(i, "w " * (i % 17), "en", None if i % 11 == 0 else f"s{i % 5}", 0, 9, "x") for i in range(3000)]
    out = mix(spark, rows).toPandas()
    assert (out["size"] == out.doc_id % 17).all()
    sizes = out.groupby("source", dropna=False)["size"].sum()
    want = brute({None if s != s or s is None else s: int(n) for s, n in sizes.items()}, (3.0, 1.0, 2.0))
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6
        assert abs((g["size"] * g.times).sum() - want[s]) <= 17
    assert out.times.max() <= 2
    again = mix(spark, rows[::-1]).toPandas().set_index("doc_id").times
    assert (again.sort_index() == out.set_index("doc_id").times.sort_index()).all()


def test_nulls_empty_repeats(spark):
    rows = [(1, None, None, None, None, 0, ""), (2, "", "en", "a", 0, 0, ""), (None, "one two", "en", "a", 0, 0, ""), (3, "x", None, "b", 1, 0, ""), (3, "x", None, "b", 1, 0, "")]
    out = mix(spark, rows).toPandas()
    assert len(out) == 5 and out["size"].tolist().count(0) == 2
    assert mix(spark, []).count() == 0
    assert mix(spark, [(1, None, "en", "a", 0, 0, "")]).toPandas().target.tolist() == [0.0]


def test_hot_source_and_long_text(spark):
    rows = [(i, "w " * 50, "en", "hot" if i % 3 else f"c{i}", 0, 0, "") for i in range(900)] + [(9999, "w " * 20_000, "en", "hot", 0, 0, "")]
    out = mix(spark, rows).toPandas()
    hot = out[out.source == "hot"]
    assert abs((hot["size"] * hot.times).sum() - hot.target.iloc[0]) <= 20_000


def test_stage_repeats_rows(spark):
    rows = [(i, "w " * 5, "en", f"s{i % 3}", 10, 0, "") for i in range(90)]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert abs(out.count() - 135) <= 3
