import random

import pytest

from edgeloom.llm.chats import LOG, SQL, Template, folded, formatted, log_of, op12_chat_format, read_back

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[NAME]", "[/ROLE]", "\\", "<", "[", "]", ">", "/s>", "s>", "INST]", "\n", "a", " ", "é", "😀", ""]


def event(seq, kind, message=None, role=None, text=None):
    return {"seq": seq, "kind": kind, "message": message, "role": role, "text": text}


def test_texts_come_back():
    t, rng = Template(), random.Random(6)
    some = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    for _ in range(6000):
        messages = [(rng.choice(["user", "assistant", "system", "tool", "", some()]), some()) for _ in range(rng.randint(0, 5))]
        whole, spans = t.rendered(messages)
        assert t.parsed(whole) == messages
        assert [t.restored(whole[a : a + n]) for a, n in spans] == [x for r, x in messages if r == "assistant"]
        for _, x in messages:
            assert not any(m in t.escaped(x) for m in ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[NAME]", "[/ROLE]"])


def test_marks_that_texts_could_complete_are_refused():
    with pytest.raises(ValueError):
        Template(roles={"user": ("aba", "cc")})
    with pytest.raises(ValueError):
        Template(roles={"user": ("\\x", "cc")})


def test_events_fold():
    fold = lambda *e: folded([event(i, *x) for i, x in enumerate(e)])
    assert fold(("open", 1, "user"), ("delta", 1, None, "a"), ("open", 2, "assistant"), ("delta", 2, None, "b"), ("delta", 1, None, "c")) == [("user", "ac"), ("assistant", "b")]
    assert fold(("open", 1, "user", "x"), ("edit", 1, None, "y"), ("delta", 1, None, "z")) == [("user", "yz")]
    assert fold(("open", 1, "user", "x"), ("edit", 1, "tool", None)) == [("tool", "")]
    assert fold(("open", 1, "a", "x"), ("open", 2, "b", "y"), ("open", 3, "c", "z"), ("regenerate", 2), ("delta", 3, None, "!"), ("delta", 2, None, "new")) == [("a", "x"), ("b", "new")]
    assert fold(("open", 1, "a", "x"), ("open", 2, "b", "y"), ("delete", 1), ("delta", 1, None, "z")) == [("b", "y")]
    assert fold(("open", 1, "a", "x"), ("open", 2, "b", "y"), ("open", 1, "c", "z")) == [("b", "y"), ("c", "z")]
    assert fold(("delta", 1, None, "x"), ("regenerate", 1), ("what", 1)) == []


def test_odd_logs(spark):
    rows = [(1, 3, "delta", 1, None, "c"), (1, 1, "open", 1, "user", None), (1, 2, "delta", 1, None, "b"), (1, None, "open", 9, None, "first"), (None, 1, "open", 1, "user", "n"), (2, 1, "delta", 1, None, "lost"), (3, 1, "open", 1, "assistant", "x" * 300_000 + "</s>")]
    rows += [(4, 1, "open", 1, "user", "a"), (4, 2, "delta", 1, None, "b"), (4, 2, "delta", 1, None, "b")]
    log = spark.createDataFrame(rows, LOG)
    back = {r["conv_id"]: r for r in read_back(formatted(log)).collect()}
    said = {c: [(m["role"], m["text"]) for m in r["messages"]] for c, r in back.items()}
    assert said == {1: [("", "first"), ("user", "bc")], None: [("user", "n")], 2: [], 3: [("assistant", "x" * 300_000 + "</s>")], 4: [("user", "abb")]}
    assert back[3]["learned"] == ["x" * 300_000 + "</s>"] and back[2]["formatted_chars"] == 0
    assert formatted(spark.createDataFrame([], LOG)).count() == 0


def test_tables_of_turns(spark):
    rows = [(1, 0, "user", "a\nb\n"), (1, 0, "user", "a\nb\n"), (1, 2, "assistant", None), (1, None, None, "z"), (1, 1, "assistant", "\n\n")]
    log = log_of(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    seqs = sorted(r["seq"] for r in log.collect())
    assert seqs == list(range(len(seqs)))
    r = read_back(formatted(log)).first()
    assert [(m["role"], m["text"]) for m in r["messages"]] == [("", "z"), ("user", "a\nb\n"), ("user", "a\nb\n"), ("assistant", "\n\n"), ("assistant", "")]
    assert list(r["learned"]) == ["\n\n", ""]


def test_query_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([None, *["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(9)]])) for c in range(40) for t in range(rng.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op12_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(f"SELECT {', '.join(out.columns)} FROM ({SQL})").fetchall())
