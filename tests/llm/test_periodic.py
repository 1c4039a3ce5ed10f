import hashlib
import random

from edgeloom.llm import periodic
from edgeloom.llm.periodic import collapsed, looped, op11_periodic_runs, runs_of, with_runs


def plain(w):
    """Runs of a list of words: every period, every stretch, the smallest period of each."""
    best = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                best.setdefault((s, i - s + p), p)
            i = max(i, s + 1)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]


def texts(rng, most):
    n, letters = rng.choice([0, 1, 5, 6, 7, 12, 20, 40, most]), rng.choice([1, 2, 3, 5])
    w = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 3))
        w = w[:s] + [w[s + k % p] for k in range(n - s)]
    return w


def test_runs_equal_the_plain_search(monkeypatch):
    rng = random.Random(4)
    for trial in range(1200):
        monkeypatch.setattr(periodic, "TOGETHER", rng.choice([1, 10, 1 << 20]))
        many = [texts(rng, 130) for _ in range(rng.randint(1, 7))]
        for w, got in zip(many, runs_of(many)):
            assert [tuple(r) for r in got.tolist()] == plain(w)
            assert collapsed(w, got) == kept(w, plain(w))


def test_one_word_many_times_and_a_long_period():
    assert runs_of([[b"x"] * 5000])[0].tolist() == [[0, 5000, 1]]
    w = [b"%d" % i for i in range(700)] * 4 + [b"end"]
    assert runs_of([w])[0].tolist() == [[0, 2800, 700]] and collapsed(w, runs_of([w])[0]) == w[:700] + [b"end"]


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "a a a a a a", 0), (2, "a a a a a a", 0), (None, "b c\tb\nc b c b c  x", 0), (3, " \n ", 0)]
    out = with_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert [[tuple(x) for x in r["runs"]] for r in out] == [[], [], [(0, 6, 1)], [(0, 6, 1)], [], []]
    assert [r["kept"] for r in out] == ["", "", "a", "a", "b c b c b c b c  x", ""]
    assert with_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_plain(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(x.decode() for x in texts(rng, 90))) for i in range(120)] + [(120, None), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w = looped((t or "").encode().split(), d)
        runs, r = plain(w), got[d]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(kept(w, runs))).hexdigest()
