import random

import pytest

pytest.importorskip("public_tokenizers")
from edgeloom.llm.pieces import PieceTable, model_path, with_pieces  # noqa: E402

PARTS = ["a", "b", " ", "  ", "\n", "é", "▁", "ﬁ", "中", "日本", "😀", "\x00", "\t", "<s>", "</s>", "<0x41>", "the", ".", "1", "99", "½", "é", "​", "ß", "한국어", "   ", "don't", "\r\n", "İ", "tion", "ing"]


def test_ids_equal_the_library():
    t, rng = PieceTable(model_path()), random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert t.encode(s).tolist() == t.sp.encode(s), s
    for _ in range(2000):
        s = "".join(chr(rng.choice([rng.randint(32, 127), rng.randint(1, 0x2FFF), rng.randint(0x3000, 0xD7FF)])) for _ in range(rng.randint(0, 30)))
        assert t.encode(s).tolist() == t.sp.encode(s), s
    long = " ".join(rng.choice(PARTS) for _ in range(30_000))
    assert t.encode(long).tolist() == t.sp.encode(long)


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "hello world", 7), (3, "hello world", 7), (None, " x\n", 8)]
    out = with_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids int"), model_path()).collect()
    sp = PieceTable(model_path()).sp
    assert [r["ids"] for r in out] == [sp.encode(r[1] or "", add_eos=True) for r in rows]
    assert [r["decoded"] for r in out] == [sp.decode(sp.encode(r[1] or "")) for r in rows]
    assert with_pieces(spark.createDataFrame([], "doc_id long, text string"), model_path()).count() == 0


def test_what_is_remembered_is_bounded(monkeypatch):
    from edgeloom.llm import pieces

    monkeypatch.setattr(pieces, "WORDS", 40)
    monkeypatch.setattr(pieces, "PAIRS", 64)
    t, rng = PieceTable(model_path()), random.Random(2)
    for _ in range(400):
        many = [" ".join(rng.choice(PARTS) + rng.choice(PARTS) for _ in range(rng.randint(0, 9))) + rng.choice(["", "x" * 80, "é" * 70]) for _ in range(3)]
        assert [x.tolist() for x in t.encode_all(many)] == [t.sp.encode(s) for s in many]
        assert len(t.known) <= 20 and len(t.pairs) == 64 and not any(len(w) > pieces.LONG for w in [*t.known, *t.old])


def test_pairs_stand_as_their_merges_say():
    t, rng = PieceTable(model_path()), random.Random(3)
    ids = list(t.text)
    tested = 0
    while tested < 3000:
        a, b = rng.choice(ids), rng.choice(ids)
        x, y = t.text[a], t.text[b]
        if len(x + y) <= 24:
            assert t.stands(a << 32 | b) == (t.merged(x + y) == [x, y]), (x, y)
            assert t.stands(t.start << 32 | b) == (t.merged(y) == [y])
            tested += 1
