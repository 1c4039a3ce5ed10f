import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from edgeloom.llm import shingle_join
from edgeloom.llm.shingle_join import linked, stage, t_occurrence


def brute(rows, k, num, den):
    sets, node = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
        sets.append((i, s))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists, both = defaultdict(list), Counter()
    for x, (_, s) in enumerate(sets):
        for t in s:
            lists[t].append(x)
    for near in lists.values():
        for b in range(len(near)):
            for a in range(b):
                both[near[a], near[b]] += 1
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a][1]) + len(sets[b][1]) - n):
            up[root(a)] = root(b)
    low = defaultdict(lambda: None)
    for x, (i, _) in enumerate(sets):
        low[root(x)] = min(i, low[root(x)]) if low[root(x)] is not None else i
    return Counter((i, len(s), low[root(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            t = docs[rng.randrange(len(docs))].split()
            for _ in range(rng.randint(0, 4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.7:
            t = passage + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        else:
            t = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        docs.append(" ".join(t))
    return [(100 + 7 * i, t.upper() if i % 9 == 0 else t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_equals_brute_force(spark, k, num, den):
    rows = corpus(k)
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
    assert Counter(map(tuple, out)) == brute(rows, k, num, den)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "GROUP_SHINGLES", 200)
    rows = corpus(11) + [(5000 + i, " ".join(f"w{j}" for j in range(40)) + f" w{i % 7}") for i in range(60)]
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert Counter(map(tuple, out)) == brute(rows, 3, 90, 100)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A\nb"), (5, "a b"), (None, "a b"), (7, "x " * 5000), (8, "x " * 6000), (9, "é B c d"), (10, "É b c d")]
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    got = Counter(map(tuple, out))
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1
    assert got[(4, 1, 4)] == 1 and got[(5, 1, 4)] == 2 and got[(None, 1, 4)] == 1
    assert got[(7, 1, 7)] == got[(8, 1, 7)] == 1
    assert got[(9, 2, 9)] == got[(10, 2, 10)] == 1
    assert linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_and_null_keys_keep_their_own_sets(spark):
    text = lambda start, extra="": " ".join(f"w{start + j}" for j in range(60)) + extra
    # ids 0 to 7 stand for two texts each, and each text has a near copy under an id of its own
    rows = [(i, text(1000 * i + 100 * k)) for i in range(8) for k in range(2)]
    rows += [(100 + 2 * i + k, text(1000 * i + 100 * k, " x")) for i in range(8) for k in range(2)]
    # texts with null ids only, near copies of texts with an id and of each other
    rows += [(None, text(50_000)), (None, text(50_000)), (200, text(50_000, " x")), (None, text(60_000)), (None, text(60_000, " x"))]
    got = Counter(map(tuple, linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    want = Counter((i, 58, i) for i in range(8) for _ in range(2)) + Counter((100 + 2 * i + k, 59, i) for i in range(8) for k in range(2))
    want += Counter([(None, 58, 200)] * 2 + [(200, 59, 200), (None, 58, None), (None, 59, None)])
    assert got == want


def test_words_of_equal_checksum_differ(spark):
    # the two last words have the same crc32 under any start value
    text = "a b c d e f g h i j k l"
    rows = [(1, f"{text} hxcmqurip"), (2, f"{text} oxexryexh"), (3, f"{text} zzz")]
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert Counter(map(tuple, out)) == Counter([(1, 11, 1), (2, 11, 2), (3, 11, 3)])


def test_order_of_rows_and_batches_does_not_matter(spark):
    rows = corpus(5) + [(i, t) for i, t in corpus(6)][:40]
    rng = random.Random(1)
    want = brute(rows, 3, 90, 100)
    for parts in (1, 7):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter(map(tuple, linked(docs, 3, 90, 100).collect())) == want


def test_sets_whose_ids_meet_take_the_other_half_of_their_names(spark, monkeypatch):
    name = shingle_join._name

    def meeting(s, clash=frozenset()):
        again = name(s)[1]
        node = len(s)  # sets of one size meet
        return (again if node in clash else node), again

    monkeypatch.setattr(shingle_join, "_name", meeting)
    rows = corpus(8, 60)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(shingle_join)
    try:
        out = linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(shingle_join)
    assert Counter(map(tuple, out)) == brute(rows, 3, 90, 100)


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "LIST", 5)
    rows = corpus(12) + [(5000 + i, " ".join(f"w{j}" for j in range(40 + i % 9)) + f" w{i % 7}") for i in range(60)]
    out = linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert Counter(map(tuple, out)) == brute(rows, 3, 90, 100)


def test_search_of_one_block():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(80)]
    links = t_occurrence(sets, 60, 100)
    for x, y in links:
        n = len(np.intersect1d(sets[x], sets[y]))
        assert 100 * n >= 60 * (len(sets[x]) + len(sets[y]) - n)
    up = list(range(80))
    root = lambda x: x if up[x] == x else root(up[x])
    for x, y in links:
        up[root(x)] = root(y)
    for x in range(80):
        for y in range(x):
            n = len(np.intersect1d(sets[x], sets[y]))
            if 100 * n >= 60 * (len(sets[x]) + len(sets[y]) - n):
                assert root(x) == root(y)


def test_stage_keeps_one_of_each_group(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + (f" v{i}" if i % 2 else ""), "en", "s", 1, "extra") for i in range(10)] + [(50, "other words here", "en", "s", 1, ""), (50, "other words here", "en", "s", 1, ""), (None, None, None, None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    out = stage(spark, docs, None)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, 0, 50]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
