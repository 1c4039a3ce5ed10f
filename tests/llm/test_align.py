import hashlib
import random
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from edgeloom.llm import align  # noqa: E402

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "é", "▁", "ﬁ", "中", "日本", "😀", "\x00", "\t", "<s>", "<0x41>", "the", ".", "1", "99", "½", "́", "​", "ß", "한국어", "   ", "don't", "\r\n", "İ", "tion", "᠎", "\x1c", "\xa0", "　", "\x85", "<|endoftext|>"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), align.byte_tokens(PATHS[0]), align.piece_tokens(PATHS[1])


def plain(rows, tools):
    """Results by whole texts, token by token."""
    a, b, ta, tb = tools
    out, held, links = [], Counter(), []
    for _, t in rows:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba, bb = [ta.bytes[i] for i in ia], [tb.bytes[i] for i in ib]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append((0, 0, 0, ""))
            links.append(Counter())
            continue
        groups, x, y, na, nb = [([], [])], 0, 0, 0, 0
        while x < len(ia) or y < len(ib):
            if na <= nb and x < len(ia):
                groups[-1][0].append(ia[x])
                na, x = na + len(ba[x]), x + 1
            else:
                groups[-1][1].append(ib[y])
                nb, y = nb + len(bb[y]), y + 1
            if na == nb and y:
                groups.append(([], []))
        groups.pop()
        mine = Counter((i, j) for p, q in groups for i in p for j in q)
        held.update(mine.keys())
        links.append(mine)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(ia), len(ib), len(groups), hashlib.sha256(text.encode()).hexdigest()))
    most: dict = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return sorted(
        (-1 if d is None else d, *o[:3], sum(m.values()), sum(k for (i, j), k in m.items() if held[i, j] == most[i]), sum(k * held[p] for p, k in m.items()), o[3]) for (d, _), o, m in zip(rows, out, links)
    )


def some_text(rng, parts=14):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, parts)))


def test_cuts_keep_the_ids(tools):
    a, b, ta, tb = tools
    cut, rng = align.Cutter(tb.cuts), random.Random(8)
    assert tb.cuts == " \n"
    for _ in range(4000):
        t = some_text(rng) or "x"
        segments = [align.segment_of(k) for k in cut.keys(t)]
        assert "".join(segments) == " " + t
        assert [i for s in segments for i in ta.ids([s])[0]] == a.encode(" " + t, add_special_tokens=False).ids, t
        if "▁" not in t:  # such a text has no alignment
            assert [i for x in tb.segment_ids(segments) for i in x.tolist()] == b.encode(t), t


def test_no_cut_after_any_kind_of_white_space(tools):
    """Every character before a space: where it is cut, both parts are encoded as the whole."""
    a, _, ta, tb = tools
    cut = align.Cutter(tb.cuts)
    texts = [f"x{chr(c)} y" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    for t, whole in zip(texts, ta.ids([" " + t for t in texts])):
        assert [i for k in cut.keys(t) for i in ta.ids([align.segment_of(k)])[0]] == whole, repr(t)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_query_equals_whole_texts(spark, tools, tmp_path, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    monkeypatch.setattr(align, "TOGETHER", max(50, block // 1000))
    monkeypatch.setattr(align, "APART", max(3, block // 2000))
    rng = random.Random(9)
    rows = [(i, " ".join(some_text(rng, 3) for _ in range(rng.randint(0, 30))).replace("▁", rng.choice(["▁", "_", "_", "_"]))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "the " * 3000), (205, "é" * 4000), (206, "the cat"), (206, "the cat"), (None, "a b c"), (207, "\\u0301" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = align.op13_token_alignment(spark, str(tmp_path)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in got) == plain(rows, tools)


def test_texts_of_groups_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "hello world", 3)], "doc_id long, text string, n_a int")
    r = align.alignments(docs, *PATHS).first()
    a, b, *_ = r["groups"].split(";")[0].split("|") + [""]
    assert r["n_groups"] == len(r["groups"].split(";")) == 2 and a and b
    empty = align.alignments(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
