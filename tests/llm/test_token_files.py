import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from edgeloom.llm.token_files import WordCoder, compressed, digests, document, expanded, read_token_files, write_token_files  # noqa: E402


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_library(path):
    c, rng = WordCoder(path), random.Random(2)
    parts = ["The", "é", "É", " ", "\n", "\t", "don't", "it's", "WE'LL", "12", "½", "²", "#", "##!", "</w>", "<|endoftext|>", "\x85", "\xa0", "\xad", "ß", "Σ", "ς", "İ", "中", "😀", "ŋ", "Ÿ", "é", "|", "'", "'x", "ﬁ", "\x1f", "Ⱥ", "tion"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    many += ["".join(chr(rng.randint(1, 0x24F)) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for _ in range(2):
        for t, ids in zip(many, c.encode(many)):
            assert ids.tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_the_library_default(path):
    from tokenizers import Tokenizer

    c, fresh = WordCoder(path), Tokenizer.from_file(path)
    assert c.encode(["a <|endoftext|> b"])[0].tolist() == [320, 49407, 321]
    many = ["<|startoftext|>The text<|endoftext|>", "A<|ENDOFTEXT|>b", "é <|endoftext|>\n", "<|endoftext", "中<|startoftext|>", "endoftext <| endoftext |>", "plain text"]
    for _ in range(2):
        for t, ids in zip(many, c.encode(many)):
            assert ids.tolist() == fresh.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 5, rng.integers(0, 90)) for _ in range(60)] + [np.zeros(rng.integers(0, 50), int)]
    phrase = rng.integers(0, 50, 12)
    docs += [np.concatenate([phrase] * int(rng.integers(1, 6))) for _ in range(30)]
    docs = [np.append(d, 2).astype(np.int32) for d in docs]
    lengths = np.array([len(d) for d in docs], np.int32)
    ids = np.concatenate(docs)
    rules, expansions, symbols, ends = compressed(ids, lengths, 100)
    assert (expanded(symbols, rules, 100) == ids).all()
    assert len(symbols) < 0.6 * len(ids)
    for r in range(len(rules)):
        assert len(expanded(np.array([100 + r], np.int32), rules, 100)) == expansions[r]
    row = {"lengths": lengths.tobytes(), "ends": ends.tobytes(), "rules": rules.tobytes(), "symbols": symbols.tobytes(), "base": 100}
    for i, d in enumerate(docs):
        assert (document(row, i) == d).all()


def test_files(spark, path, tmp_path):
    rows = [(9, "The same the same the same " * 200, 1), (2, None, 1), (4, "", 1), (7, "a b", 1), (7, "a b", 1), (None, "first", 1), (3, "中文 text", 1)] + [(100 + i, f"word{i} of text", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    at = f"file://{tmp_path}/set"
    write_token_files(docs, at, path)
    t = WordCoder(path).tokenizer
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    order = lambda r: (r[1], r[0] is not None)
    assert sorted(map(tuple, digests(spark, at).collect()), key=order) == sorted(want, key=order)
    got = read_token_files(spark, at).collect()
    assert sum(len(r["ids"]) for r in got) == start and {r["ids"][-1] for r in got} == {2}
    empty = f"file://{tmp_path}/none"
    write_token_files(docs.limit(0), empty, path)
    assert digests(spark, empty).count() == 0 and read_token_files(spark, empty).count() == 0


def test_a_word_is_cut_once_however_often_it_stands(path):
    coder = WordCoder(path)
    cut, seen = coder.parts, []
    coder.parts = lambda word: seen.append(word) or cut(word)
    many = ["They're  in\tBox\xa012, isn't it? " * 500, "", "\n", "it? <|endoftext|> in", "box\xa012, naïve"]
    got = [ids.tolist() for ids in coder.encode(many)]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in many]
    assert sum(map(len, seen)) < 100
