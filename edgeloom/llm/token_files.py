"""Token ids in files compressed by grammar: Re-Pair per block, with random access to documents.

A file set is Parquet. Each row is a block of whole documents in ascending id order, of about BLOCK ids:

    part, block   where the block stands: range of ids, then place in it
    doc_ids       the documents
    lengths       ids of each document, int32
    ends          where each document ends in ``symbols``, int32
    rules         pairs of int32: rule r replaces its pair by the symbol ``base + r``
    expansions    ids that each rule stands for, int32
    symbols       the block, int32
    base, n_ids   the first nonterminal; ids in the block

Re-Pair replaces the most frequent pair of neighbours by a new symbol, again and again. Here each round takes,
most frequent first, all pairs that can't overlap (no symbol is the left of one and the right of
another), which gives what replacing them one by one would give. Pairs never cross documents,
so a document is read by expanding its own symbols.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import slices, table, texts
from edgeloom.session import join_counted, shared_dir

#: Ids of a block, rounds of replacement, rules of a round, and how often a pair must occur to be replaced.
BLOCK, ROUNDS, RULES, OFTEN = 1 << 19, 5, 3000, 12
#: Parts of texts whose ids one Python worker remembers (about 150 MB).
REMEMBERED = 700_000
#: The id written after each document.
END = 2
#: Characters whose normal form, case and classes are the same for Python and the tokenizer: a text of only these is encoded part by part.
PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-\u012f\u0131-\u017e]")


def _parts() -> re.Pattern:
    """The tokenizer's own pattern over plain characters: contractions, runs of letters, single numbers, runs of others."""
    kind: dict[str, str] = {"L": "", "N": "", "s": ""}
    for c in map(chr, range(0x180)):
        kind["s" if c.isspace() else unicodedata.category(c)[0]] = kind.get("s" if c.isspace() else unicodedata.category(c)[0], "") + c
    letters, numbers, spaces = (re.escape(kind[k]) for k in "LNs")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


class WordCoder:
    """The tokenizer of a file, with the ids of the parts it cuts texts into remembered.

    No token crosses the border of a part, and only the last token of a part has the word-end mark, so many new
    parts are encoded together and told apart by it. A text that holds an added token such as <|endoftext|>, in any case,
    is encoded whole, as the library finds these before it cuts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _parts().findall
        self.known: dict[str, bytes] = {}
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _adds(self, low: str) -> bool:
        return any(a in low for a in self.added)

    def learn(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            ids = np.array(self._ids(" ".join(some)), np.int32)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(some) or ends[-1] != len(ids):
                self.known.update((p, np.array(self._ids(p), np.int32).tobytes()) for p in some)
                continue
            raw = ids.tobytes()
            self.known.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, [0, *ends], ends))

    def encode(self, many: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without an end id.

        Texts are split at white space, which no part crosses, so each different word of ``many`` is cut into parts once.
        """
        plain = [None if PLAIN.search(t) or self._adds(low := t.lower()) else low for t in many]
        split = pc.ascii_split_whitespace(pa.array([t or "" for t in plain], pa.string()))
        words = split.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        collects = gc.isenabled()
        gc.disable()  # the many small lists hold no circles
        try:
            cut = list(map(self.parts, words.dictionary.to_numpy(zero_copy_only=False).tolist()))
            parts = list(chain.from_iterable(cut))
            raw = list(map(self.known.get, parts))
            if None in raw:
                self.learn(list({p for p, r in zip(parts, raw) if r is None}))
                raw = list(map(self.known.__getitem__, parts))
        finally:
            if collects:
                gc.enable()
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) // 4)])  # of parts, then of words, then of texts
        ends = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])]
        ids, at = np.frombuffer(b"".join(raw), np.int32), words.indices.to_numpy()
        first, size = ends[at], ends[at + 1] - ends[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        ends = ends[split.offsets.to_numpy()].tolist()
        return [np.array(self._ids(t), np.int32) if p is None else ids[a:b] for t, p, a, b in zip(many, plain, ends, ends[1:])]


_coders: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def compressed(ids: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansions, symbols, ends) of a block of documents laid end to end."""
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[tuple[int, int]] = []
    size: dict[int, int] = {}
    for _ in range(ROUNDS):
        if len(seq) < 2:
            break
        a, b = seq[:-1], seq[1:]
        h = (a * 0x9E3779B1 + b * 0x85EBCA77) >> 7 & 0xFFFFF
        h[last[:-1]] = 1 << 20
        many = np.bincount(h, minlength=(1 << 20) + 1)
        many[1 << 20] = 0
        at = np.flatnonzero((many >= OFTEN)[h])
        narrow = base + len(rules) < 1 << 16  # sorts faster
        shift = 16 if narrow else 32
        key = (a[at] << shift | b[at]).astype(np.uint32 if narrow else np.int64)
        by = np.argsort(key)
        ranked = key[by]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
        pairs, times = ranked[first].astype(np.int64), np.diff(first, append=len(ranked))
        place = np.empty(len(key), np.int64)
        place[by] = np.repeat(np.arange(len(pairs)), times)
        order = np.flatnonzero(times >= OFTEN)
        order = order[np.argsort(-times[order], kind="stable")]
        symbol = np.full(len(pairs), -1)
        lefts, rights = set(), set()
        for p in order.tolist():
            x, y = int(pairs[p]) >> shift, int(pairs[p]) & (1 << shift) - 1
            if x in rights or y in lefts or (x == y and (x in lefts or y in rights)):
                continue
            lefts.add(x)
            rights.add(y)
            symbol[p] = base + len(rules)
            size[base + len(rules)] = size.get(x, 1) + size.get(y, 1)
            rules.append((x, y))
            if len(lefts) >= RULES:
                break
        if not lefts:
            break
        new = symbol[place]
        at, new = at[new >= 0], new[new >= 0]
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # in a run of one symbol every second pair
        first = (np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))) % 2 == 0
        at, new = at[first], new[first]
        seq[at] = new
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    ends = np.zeros(len(lengths), np.int32)
    ends[lengths > 0] = np.flatnonzero(last) + 1
    ends = np.maximum.accumulate(ends) if len(ends) else ends
    return np.array(rules, np.int32).reshape(-1, 2), np.array([size[base + r] for r in range(len(rules))], np.int32), seq.astype(np.int32), ends


def expanded(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of some symbols, one level of rules at a time."""
    while True:
        r = symbols >= base
        if not r.any():
            return symbols
        at = np.cumsum(1 + r) - 1 - r
        out = np.empty(len(symbols) + int(r.sum()), np.int32)
        out[at[~r]] = symbols[~r]
        pair = rules[symbols[r] - base]
        out[at[r]], out[at[r] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


SCHEMA = "part int, block int, doc_ids array<long>, lengths binary, ends binary, rules binary, expansions binary, symbols binary, base int, n_ids long"


def _together(batches, most: int = 4 << 20):
    """Keys and texts of batches, about ``most`` bytes at a time: what texts share is looked up once for all of them."""
    keys, many, size = [], [], 0
    for whole in batches:
        for batch in slices(whole, 1):
            keys += batch.column(0).to_pylist()
            many += texts(batch.column(1))
            size += batch.column(1).nbytes
            if size >= most:
                yield keys, many
                keys, many, size = [], [], 0
    if keys:
        yield keys, many


def _blocks(path: str):
    def run(batches):
        coder = word_coder(path)
        base = coder.tokenizer.get_vocab_size()
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        rows: list[np.ndarray] = []
        held = 0

        def out():
            lengths = np.array([len(r) for r in rows], np.int32)
            rules, expansions, symbols, ends = compressed(np.concatenate(rows), lengths, base)
            parts = [lengths, ends, rules, expansions, symbols]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([base], pa.int32()), pa.array([held], pa.int64())], [f.split()[0] for f in SCHEMA.split(", ")])

        end = np.array([END], np.int32)
        for keys, many in _together(batches):
            for d, ids in zip(keys, coder.encode(many)):
                docs.append(d)
                rows.append(np.append(ids, end))
                held += len(ids) + 1
                if held >= BLOCK:
                    yield out()
                    docs, rows, held, block = [], [], 0, block + 1
        if docs:
            yield out()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write every text of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order, null ids first.

    A null or empty text is its end id alone. Rows that share an id stand in order of a hash of
    their text. An empty table writes no blocks; other columns are not written.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(_blocks(tokenizer), SCHEMA).write.parquet(path)


def block_of(row) -> tuple:
    """Arrays of a block row: lengths, ends, rules, symbols."""
    read = lambda x: np.frombuffer(x, np.int32)
    return read(row["lengths"]), read(row["ends"]), read(row["rules"]).reshape(-1, 2), read(row["symbols"])


def document(row, i: int) -> np.ndarray:
    """Ids of the i-th document of a block, expanding nothing else."""
    _, ends, rules, symbols = block_of(row)
    return expanded(symbols[ends[i - 1] if i else 0 : ends[i]], rules, row["base"])


def read_token_files(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in a file set; start counts the ids of all documents before it."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                lengths, _, rules, symbols = block_of(row)
                ids = expanded(symbols, rules, row["base"])
                ends = np.cumsum(lengths, dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "start", "ids"])

    return _located(spark, path).mapInArrow(run, "doc_id long, start long, ids array<int>")


def _located(spark, path: str) -> DataFrame:
    """Blocks with the start of each: parts are few, and blocks of a part are summed beside each other."""
    blocks = spark.read.parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    starts = starts.join(F.broadcast(parts), "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("start"))
    return join_counted(blocks, starts, ["part", "block"], blocks.count())


def digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from a file set; a document's ids stay in Python."""

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                lengths, _, rules, symbols = block_of(row)
                raw = memoryview(expanded(symbols, rules, row["base"]).astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _located(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(spark, path)
