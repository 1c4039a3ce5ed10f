"""SentencePiece merge-type encoding by a table of prefixes, and decoding.

A merge-type encoding is local: cut out any run of neighbouring tokens and it is the encoding
of its own text. So the encoding of a prefix ends in one token only, and that token is the one
which (a) ends the prefix, and (b) stands with the last token of what is before it exactly as the
two would be encoded together. An Aho-Corasick automaton over the vocabulary gives the tokens that
end at each place. A pair stands unless some part on the right edge of the first would have merged with some part
on the left edge of the second before either was merged inwards; answers are remembered. The table holds
one token per prefix and the ids are read off it backwards from the end of the text.

Where no piece of the vocabulary crosses a place the text is cut there (before a run of space
marks, at a line feed), so the table is as long as a word and words are remembered. The new words of a batch
are laid end to end and fill their tables together, one column after another.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import fresh, give_back, held_columns, small_batches, table, texts

SPACE = "▁"
#: Encoded words that one Python worker remembers (about 60 MB), and places for answers about pairs (8 MB).
WORDS, PAIRS = 250_000, 1 << 20
#: Words longer than this are encoded by themselves and not remembered.
LONG = 64


class PieceTable:
    """The encoder of one model file."""

    def __init__(self, model_path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.auto = ahocorasick.Automaton()
        multi = set()
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            self.rank[piece], self.ids[piece] = sp.get_score(i), i
            if len(piece) > 1:
                self.auto.add_word(piece, i)
                multi.add(piece)
        self.auto.make_automaton()
        self.size = [0] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.size[i] = len(p)
        self.text = {i: p for p, i in self.ids.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        self.inside = {c for p in multi for c in p}
        self.partial = self.inside - self.single  # characters that are no piece but part of one
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        cut = not any(SPACE in p.lstrip(SPACE) for p in multi)
        lines = cut and "\n" not in self.inside
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cut else "(?s:.+)").findall
        self.start = sp.get_piece_size()
        self.sizes = np.array(self.size + [0], np.int64)
        self.alone = np.full(0x110000, -1, np.int32)  # pieces of one character need no automaton
        for c in self.single:
            self.alone[ord(c)] = self.ids[c]
        self.pairs = np.full(PAIRS, -1, np.int64)  # at the hash of a pair, twice the pair and whether it stands
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.few: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves, one by one: best score first, leftmost of equals. For short texts."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; none for a piece that is never merged from its characters."""
        if piece not in self.halves:
            parts, rank = list(piece), self.rank
            last = None
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or r > best):
                        best, at = r, k
                if best is None:
                    last = None
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = last
        return self.halves[piece]

    def stands(self, key: int) -> bool:
        """Whether a pair of tokens, or the start of a text and a token, is encoded as just these."""
        a, b = key >> 32, key & 0xFFFFFFFF
        y = self.text[b]
        if len(y) > 1 and self._halves(y) is None:
            return False
        if a == self.start:
            return True
        x, rank = self.text[a], self.rank
        if len(x) > 1 and self._halves(x) is None:
            return False
        # from the whole tokens inwards: until when (by score) the parts on both edges stand side by side
        until_x = until_y = None
        while True:
            both = rank.get(x + y)
            # at equal scores the leftmost goes first: the inner merge of the first token, but not that of the second
            if both is not None and (until_x is None or both > until_x) and (until_y is None or both >= until_y):
                return False
            made_x, made_y = rank[x] if len(x) > 1 else None, rank[y] if len(y) > 1 else None
            if made_x is None and made_y is None:
                return True
            if made_y is None or made_x is not None and made_x < made_y:  # the later of the two merges is undone
                until_x, x = made_x, self._halves(x)[1]
            else:
                until_y, y = made_y, self._halves(y)[0]

    def _stand(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs stand; what is not found at its place is asked once and written there."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % len(self.pairs)
        found = self.pairs[at]
        miss = np.flatnonzero(found >> 1 != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            found[miss] = np.array([k << 1 | self.stands(k) for k in new.tolist()], np.int64)[back]
            self.pairs[at[miss]] = found[miss]
        return (found & 1).astype(bool)

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids, as bytes, of words none of which has the character 0."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        joined = "\0".join(words)
        hits = np.fromiter(self.auto.iter(joined), np.dtype([("e", np.int64), ("t", np.int64)]))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        alone = np.flatnonzero((self.alone[codes] >= 0) & (codes > 0))
        e, t = np.concatenate([hits["e"], alone]), np.concatenate([hits["t"], self.alone[codes[alone]]])
        start = np.repeat(starts, lengths + 1)[e]
        n = self.sizes[t]
        column = e - start
        by = np.argsort(column.astype(np.int16), kind="stable")
        e, t, n, start, column = e[by], t[by], n[by], start[by], column[by]
        edges = np.searchsorted(column, np.arange(int(lengths.max()) + 2))
        last = np.full(int(ends[-1]) + 1, -1, np.int64)
        for i, j in zip(edges.tolist(), edges[1:].tolist()):
            at, begins = e[i:j] - n[i:j], start[i:j]
            before = np.where(at < begins, self.start, last[at])
            some = np.flatnonzero(before >= 0) + i
            some = some[self._stand(before[some - i] << 32 | t[some])]
            last[e[some]] = t[some]
        # backwards from the last character of each word
        at, open_, steps = ends - 2, np.arange(len(words)), []
        lost = np.zeros(len(words), bool)
        count = np.zeros(len(words), np.int64)
        while len(open_):
            token = last[at[open_]]
            lost[open_[token < 0]] = True
            open_, token = open_[token >= 0], token[token >= 0]
            steps.append((open_, token))
            count[open_] += 1
            at[open_] -= self.sizes[token]
            open_ = open_[at[open_] >= starts[open_]]
        to = np.cumsum(count)
        flat = np.empty(int(to[-1]), np.int32)
        for k, (w, token) in enumerate(steps):
            flat[to[w] - 1 - k] = token
        raw = flat.tobytes()
        out = [raw[a:b] for a, b in zip((4 * (to - count)).tolist(), (4 * to).tolist())]
        for i in np.flatnonzero(lost):
            out[i] = self._odd(words[i])
        return out

    def _odd(self, s: str) -> bytes:
        """A word with characters that are no pieces."""
        if not self.partial.isdisjoint(s):  # such a character may still be merged
            return array("i", [i for p in self.merged(s) for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]).tobytes()
        odd = set(s) - self.single
        if not odd:
            return self._one(s)
        out = b""
        for part in re.split("([" + re.escape("".join(odd)) + "])", s):
            if part in odd:
                out += array("i", [self.byte[b] for b in part.encode()]).tobytes()
            elif part:
                out += self._one(part)
        return out

    def _one(self, s: str) -> bytes:
        """A text all of whose characters are pieces, place by place: for long ones."""
        last, size = [-1] * len(s), self.size
        last.append(self.start)  # also last[-1], what stands before the first character
        ids = self.ids
        ends: list[list[int]] = [[ids[c]] for c in s]
        for e, t in self.auto.iter(s):
            ends[e].append(t)
        for e, t in ((e, t) for e, ts in enumerate(ends) for t in ts):
            if last[e] < 0 and (before := last[e - size[t]]) >= 0:
                key = before << 32 | t
                if (known := self.few.get(key)) is None:
                    if len(self.few) >= 50_000:
                        self.few.clear()
                    known = self.few[key] = self.stands(key)
                if known:
                    last[e] = t
        i, out = len(s) - 1, array("i")
        while i >= 0:
            out.append(last[i])
            i -= size[last[i]]
        out.reverse()
        return out.tobytes()

    def encode_all(self, many: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without an end id."""
        cut = [self.words(self.sp.normalize(t)) if t else [] for t in many]
        new = set().union(*cut) - self.known.keys()
        self.known.update((w, self.old[w]) for w in new & self.old.keys())
        new -= self.old.keys()
        odd = [w for w in new if len(w) > LONG or "\0" in w or not self.partial.isdisjoint(w)]
        self.known.update((w, self._odd(w)) for w in odd)
        plain = list(new.difference(odd))
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            self.known.update(zip(some, self._encoded(some)))
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, ws)), np.int32) for ws in cut]
        for w in odd:
            if len(w) > LONG:
                del self.known[w]
        if len(self.known) > WORDS // 2:
            self.old, self.known = self.known, {}
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_tables: dict[str, PieceTable] = {}


def piece_table(model_path: str) -> PieceTable:
    """The encoder of a model file, made once per Python process."""
    if model_path not in _tables:
        _tables[model_path] = PieceTable(model_path)
    return _tables[model_path]


def with_pieces(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` (array of int, the end id last) and ``decoded`` (the text of those ids).

    A null or empty text has the end id alone and decodes to the empty text. Each row is encoded by
    itself, so repeated rows and ties don't matter; an empty table stays empty; other columns
    stay, those that have the new names are replaced. The model file must be readable on
    every executor.
    """

    def code(column: pa.Array) -> pa.Array:
        coder = piece_table(model_path)
        end = np.array([coder.end], np.int32)
        rows = [np.append(ids, end) for ids in coder.encode_all(texts(column))]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32))
        back = pa.array([coder.sp.decode(r.tolist()) for r in rows], pa.string())
        give_back()
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), back], ["ids", "decoded"])

    coded = F.arrow_udf(code, "struct<ids: array<int>, decoded: string>")
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    (both,) = fresh(docs, "coded")
    out = docs.withColumn(both, coded(F.col(text)))
    return out.select(*kept, F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark, sf_dir) -> DataFrame:
    out = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """The pipeline's last stage: documents, each with its ids and the text decoded from them."""
    small_batches(spark)
    return with_pieces(docs.select(*held_columns(docs)), model_path())
