"""Alignment of two tokenizers over distinct segments of texts.

A byte-level BPE (A) and a SentencePiece BPE (B) encode the same text, with a space before it. Both never join a
space (or a line feed, where no piece of B holds one) to what is before it unless that is white space too, which is verified from A's
pre-tokenizer and B's vocabulary. So a text is cut before runs of white space, and its tokens are those of its segments.

1. Documents are packed into blocks of about BLOCK bytes. A block has its distinct segments, most frequent first, and the documents as numbers of these.
2. The segments of all blocks are dealt to buckets by hash and sorted, so equal ones stand together and are encoded and aligned once.
   Where a token of A and one of B end at the same byte, a group ends. An alignment is a row of small integers: the group's A ids, MIDDLE, its B ids, END.
3. The alignment of a run of equal segments goes back to every block that has it, and a block composes its documents.
4. How many documents hold a pair of ids is counted from the documents' distinct pairs; the counts are joined to them.

A segment is sent at most once a block through the shuffle, packed with others of its block and bucket, so a frequent one has as many
rows as there are blocks; what a task holds is a block, or SEGMENTS sorted rows. In a group, equal ids are counted before they are paired.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import pieces
from edgeloom.llm.common import give_back, slices, table
from edgeloom.session import dropped, join_counted, stored

#: Bytes of text in a block, segment occurrences of a block that are composed together, and segments that are aligned together.
BLOCK, TOGETHER, SEGMENTS = 8 << 20, 60_000, 50_000
#: Alignments that are taken apart together; what a block keeps of them is a tenth of what that takes.
APART = 20_000
#: Marks in an alignment; ids are smaller.
MIDDLE, END = 0xFFFF, 0xFFFE


class ByteTokens:
    """Tokenizer A of a file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]
        if spec["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"] or spec["post_processor"]:
            raise ValueError("A must be a byte-level BPE with its own cuts, without normalizer, prefix or post-processor")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others come in order from 256 on
        byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(keep)))}
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens(pieces.PieceTable):
    """Tokenizer B of a file: ids of segments, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        sp = self.sp
        self.bytes = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace(pieces.SPACE, " ").encode())
        self.sizes_b = np.array([len(b) for b in self.bytes], np.int64)
        #: White space before which texts may be cut: no piece of B holds it after another character.
        self.cuts = "".join(c for c in " \n" if not any((pieces.SPACE if c == " " else c) in p.lstrip(pieces.SPACE) for p in self.ids))

    def segment_ids(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of segments, which stand as they are (a space is a space mark)."""
        if self.sp.normalize("".join(segments)) != pieces.SPACE + "".join(segments).replace(" ", pieces.SPACE):
            raise ValueError("B must not normalize its texts")
        cut = [self.words(s.replace(" ", pieces.SPACE)) for s in segments]
        new = set().union(*cut)
        odd = {w for w in new if len(w) > pieces.LONG or "\0" in w or not self.partial.isdisjoint(w)}
        known = {w: self._odd(w) for w in odd}
        plain = list(new - odd)
        for i in range(0, len(plain), 20_000):
            known.update(zip(plain[i : i + 20_000], self._encoded(plain[i : i + 20_000])))
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in cut]


_loaded: dict[str, ByteTokens | PieceTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _loaded:
        _loaded[path] = ByteTokens(path)
    return _loaded[path]


def piece_tokens(path: str) -> PieceTokens:
    if path not in _loaded:
        _loaded[path] = PieceTokens(path)
    return _loaded[path]


class Cutter:
    """Cuts a text, with a space before it, into keys of segments.

    A segment begins with white space; the key of one that begins with a single space leaves that out.
    """

    def __init__(self, cuts: str):
        self.cuts = cuts
        spaces = "\\s\u180e"  # old tables have U+180E as white space
        self.odd = re.compile(f"[{spaces}][{cuts}]").search if cuts else None
        self.split = re.compile(f"(?<=[^{spaces}])(?=[{cuts}])").split if cuts else None

    def keys(self, text: str) -> list[str]:
        whole = " " + text
        if not self.cuts:
            return [key_of(whole)]
        if " " in self.cuts and not self.odd(whole):
            if "\n" in self.cuts:
                text = text.replace("\n", " \n")
            return text.split(" ")
        return [key_of(s) for s in self.split(whole)]


def key_of(segment: str) -> str:
    return segment[1:] if segment[0] == " " and segment[1:2] not in (" ", "\n") else segment


def segment_of(key: str) -> str:
    return key if key[:1] in (" ", "\n") and key else " " + key


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as planes of bytes: the upper ones are mostly zero and compress well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T.copy().view("<i4").ravel().astype(np.int64)


def _squeezed(*parts: bytes) -> tuple[bytes, int]:
    whole = b"".join(parts)
    return pa.compress(whole, codec="zstd", asbytes=True), len(whole)


def _restored(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True)


BLOCKS = "block long, doc_ids array<long>, sizes binary, codes binary, n_codes long, dealt array<struct<bucket: int, n: int, size: long, packed: binary>>"
DEALT = pa.list_(pa.struct({"bucket": pa.int32(), "n": pa.int32(), "size": pa.int64(), "packed": pa.binary()}))


def _dealt(names: list[str], buckets: int) -> list[dict]:
    """The segments of a block, by place, packed by the bucket of their hash."""
    raw = [x.encode("utf-8", "surrogatepass") for x in names]
    bucket = np.fromiter((zlib.crc32(x) for x in raw), np.int64, len(raw)) % buckets
    order = sorted(range(len(raw)), key=raw.__getitem__)  # neighbours share beginnings
    order = np.array(order, np.int64)[np.argsort(bucket[order], kind="stable")] if raw else np.empty(0, np.int64)
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1) != 0).tolist() + [len(order)]
    out = []
    for x, y in zip(edges, edges[1:]):
        some = order[x:y]
        parts = [raw[i] for i in some.tolist()]
        packed, size = _squeezed(_planes(some), _planes(np.array([len(r) for r in parts])), b"".join(parts))
        out.append({"bucket": int(bucket[some[0]]), "n": len(parts), "size": size, "packed": packed})
    return out


def _blocks(cuts: str, buckets: int):
    def run(batches):
        cutter = Cutter(cuts)
        part, block = TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        codes: list[int] = []
        seen: dict[str, int] = {}

        def out():
            flat = np.array(codes, np.int64)
            by = np.argsort(-np.bincount(flat, minlength=len(seen)), kind="stable")
            rank = np.empty(len(seen), np.int64)
            rank[by] = np.arange(len(seen))
            names = list(seen)
            row = [pa.array([part << 32 | block], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([np.array(sizes, np.int32).tobytes()], pa.binary())]
            row += [pa.array([_squeezed(_planes(rank[flat]))[0]], pa.binary()), pa.array([len(flat)], pa.int64()), pa.array([_dealt([names[i] for i in by.tolist()], buckets)], DEALT)]
            return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "sizes", "codes", "n_codes", "dealt"])

        held = 0
        for whole in batches:
            for batch in slices(whole, 1):
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys = cutter.keys(t) if t else []
                    docs.append(d)
                    sizes.append(len(keys))
                    codes += [seen.setdefault(k, len(seen)) for k in keys]
                    held += len(t or "")
                    if held >= BLOCK:
                        yield out()
                        docs, sizes, codes, seen, held, block = [], [], [], {}, 0, block + 1
        if docs:
            yield out()
        give_back()

    return run


def _undealt(batches):
    """Rows (block, place, segment) of packed segments."""
    for batch in batches:
        for i in range(len(batch)):
            block, n, size, packed = (batch.column(c)[i].as_py() for c in range(4))
            raw = _restored(packed, size)
            offsets = np.concatenate([[0], np.cumsum(_numbers(raw[4 * n :], n))]).astype(np.int32)
            texts = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[8 * n :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(_numbers(raw, n).astype(np.int32)), texts], ["block", "place", "segment"])


def aligned(segments: list[str], a: ByteTokens, b: PieceTokens) -> list[bytes | None]:
    """The alignments of segments; none where the tokens' bytes are not the segment's."""
    plain = [i for i, s in enumerate(segments) if not (s[-1].isspace() or s[-1] == "\u180e")]
    ids_a: list = [None] * len(segments)
    raw = [s.encode("utf-8", "surrogatepass") for s in segments]
    size = np.array([len(r) for r in raw], np.int64)
    for k in range(0, len(plain), 500):  # segments that end in no white space may stand in a row
        some = plain[k : k + 500]
        flat = np.array(a.ids(["".join(segments[i] for i in some)])[0], np.int64)
        ends = np.concatenate([[0], np.cumsum(a.size[flat])])
        at = np.searchsorted(ends, np.concatenate([[0], np.cumsum(size[some])]))
        for i, x, y in zip(some, at.tolist(), at[1:].tolist()):
            ids_a[i] = flat[x:y]
    rest = [i for i, x in enumerate(ids_a) if x is None]
    for i, x in zip(rest, a.ids([segments[i] for i in rest])):
        ids_a[i] = np.array(x, np.int64)
    ids_b = b.segment_ids(segments)
    ok = [b"".join([b.bytes[i] for i in y.tolist()]) == r and b"".join([a.bytes[i] for i in x.tolist()]) == r for x, y, r in zip(ids_a, ids_b, raw)]
    good = [i for i, o in enumerate(ok) if o]
    out: list[bytes | None] = [None] * len(segments)
    if not good:
        return out
    fa, fb = np.concatenate([ids_a[i] for i in good]), np.concatenate([ids_b[i] for i in good]).astype(np.int64)
    ea, eb = np.cumsum(a.size[fa]), np.cumsum(b.sizes_b[fb])
    both = np.intersect1d(ea, eb, assume_unique=True)
    ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
    groups = len(both)
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    begin = np.cumsum(na + nb + 2) - (na + nb + 2)
    stream = np.empty(int((na + nb + 2).sum()), np.uint16)
    stream[begin + na], stream[begin + na + nb + 1] = MIDDLE, END
    stream[begin[ga] + np.arange(len(fa)) - (np.cumsum(na) - na)[ga]] = fa
    stream[(begin + na + 1)[gb] + np.arange(len(fb)) - (np.cumsum(nb) - nb)[gb]] = fb
    data = stream.tobytes()
    upto = np.searchsorted(both, np.cumsum(size[good]))  # the last group of each segment
    to = 2 * (begin + na + nb + 2)[upto]
    for i, x, y in zip(good, [0, *to.tolist()], to.tolist()):
        out[i] = data[x:y]
    return out


ALIGNED = "block long, n int, size long, packed binary"


def _aligner(path_a: str, path_b: str):
    """From sorted rows (block, place, segment) to packed rows, one for each block among some rows; equal segments are aligned once."""

    def run(batches):
        a, b = byte_tokens(path_a), piece_tokens(path_b)
        held: list[pa.RecordBatch] = []
        rows = size = 0
        known: tuple = (None, None)  # the last segment and its alignment: its run may go on

        def out(known):
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column("segment").chunk(0).dictionary_encode()
            names = keys.dictionary.to_pylist()
            old = [known[1]] if names[0] == known[0] else []
            found = old + aligned([segment_of(k) for k in names[len(old) :]], a, b)
            which = keys.indices.to_numpy().astype(np.int64)
            block, place = t.column("block").to_numpy(), t.column("place").to_numpy().astype(np.int64)
            order = np.lexsort((place, block))
            edges = np.flatnonzero(np.diff(block[order], prepend=-1) != 0).tolist() + [len(order)]
            sizes = np.array([-1 if f is None else len(f) for f in found], np.int64)
            packed = []
            for x, y in zip(edges, edges[1:]):
                some = order[x:y]
                data = b"".join([found[i] or b"" for i in which[some].tolist()])
                packed.append((int(block[some[0]]), len(some), *reversed(_squeezed(_planes(place[some]), _planes(sizes[which[some]]), data))))
            columns = list(zip(*packed))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["block", "n", "size", "packed"])
            return batch, (names[-1], found[-1])

        for whole in batches:
            for batch in slices(whole, 2):
                held.append(batch)
                rows, size = rows + len(batch), size + batch.nbytes
                if rows >= SEGMENTS or size >= 8 << 20:
                    made, known = out(known)
                    yield made
                    held, rows, size = [], 0, 0
        if rows:
            yield out(known)[0]
        give_back()

    return run


@lru_cache(maxsize=1)
def _token_texts(width: int) -> list[str]:
    """Each id with what may follow it in a text of groups."""
    return [x + s for s in ",|;" for x in map(str, range(width))]


class Alignments:
    """Alignments one after the other (bytes of each, -1 for none): counts, texts and links of each."""

    def __init__(self, sizes: np.ndarray, v: np.ndarray, width: int):
        n = len(sizes)
        v = v.astype(np.int64)
        self.ok = sizes >= 0
        offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0) // 2)])
        row = np.repeat(np.arange(n), np.diff(offsets))
        end, mid = v == END, v == MIDDLE
        group = np.cumsum(end) - end
        is_b = (np.cumsum(mid) > group) & ~end & ~mid
        is_a = ~(is_b | end | mid)
        count = lambda m: np.bincount(row[m], minlength=n)
        self.n_a, self.n_b, self.n_groups = count(is_a), count(is_b), count(end)
        # texts: each token with what follows it
        after = np.append(v[1:], END)
        tokens = np.flatnonzero(is_a | is_b)
        table_ = _token_texts(width)
        kind = np.where(after == MIDDLE, 1, np.where(after == END, 2, 0))[tokens]
        words = list(map(table_.__getitem__, (kind * width + v[tokens]).tolist()))
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        self.text = ["".join(words[x:y]) for x, y in zip(at, at[1:])]
        # links: distinct ids of a group with their counts, each of A with each of B
        ka, ca = np.unique(group[is_a] << 32 | v[is_a], return_counts=True)
        kb, cb = np.unique(group[is_b] << 32 | v[is_b], return_counts=True)
        of_group = row[end]
        groups = int(end.sum())
        first, many = np.searchsorted(kb >> 32, np.arange(groups)), np.bincount(kb >> 32, minlength=groups)
        times = many[ka >> 32]
        left = np.repeat(np.arange(len(ka)), times)
        right = first[ka[left] >> 32] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        self.pair = ((ka[left] & 0xFFFFFFFF) << 16 | kb[right] & 0xFFFFFFFF).astype(np.uint32)
        self.times = ca[left] * cb[right]
        owner = of_group[ka[left] >> 32]
        self.links = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        self.n_links = np.bincount(owner, weights=self.times, minlength=n).astype(np.int64)

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, bytes]], width: int) -> Alignments:
        """Of many runs of (bytes of each, the bytes), APART or more at a time."""
        made, lengths, data, some = [], [], [], 0
        for i, (sizes, raw) in enumerate(parts):
            lengths.append(sizes)
            data.append(raw)
            some += len(sizes)
            if some >= APART or i + 1 == len(parts):
                made.append(cls(np.concatenate(lengths), np.frombuffer(b"".join(data), np.uint16), width))
                lengths, data, some = [], [], 0
        whole = cls(np.empty(0, np.int64), np.empty(0, np.uint16), width)
        made.append(whole)
        starts = np.cumsum([0, *(len(m.pair) for m in made)])
        whole.links = np.concatenate([*(m.links[:-1] + x for m, x in zip(made, starts.tolist())), starts[-1:]])
        whole.text = [t for m in made for t in m.text]
        for c in ("ok", "n_a", "n_b", "n_groups", "n_links", "pair", "times"):
            setattr(whole, c, np.concatenate([getattr(m, c) for m in made]))
        return whole


COMPOSED = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def _compose(width: int):
    fields = [f.split()[0] for f in COMPOSED.split(", ")]

    def run(key, segments: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(blocks):
            raise ValueError("segments of a block that is not there")
        block = blocks.slice(0, 1)
        row = {c: block.column(c).combine_chunks()[0].as_py() for c in ("of", "doc_ids", "sizes", "codes", "n_codes")}
        sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        codes = _numbers(_restored(row["codes"], 4 * row["n_codes"]), row["n_codes"])
        places, parts = [np.empty(0, np.int64)], []
        for n, size, packed in zip(*(segments.column(c).to_pylist() for c in ("n", "size", "packed"))):
            raw = _restored(packed, size)
            places.append(_numbers(raw, n))
            parts.append((_numbers(raw[4 * n :], n), raw[8 * n :]))
        at = np.empty(sum(map(len, places)), np.int64)
        at[np.concatenate(places)] = np.arange(len(at))
        codes = at[codes]
        al = Alignments.of(parts, width)
        del places, parts, at
        ends = np.cumsum(sizes)
        out = []
        first = 0
        while first < len(sizes):
            upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, side="right")))
            out.append(_documents(al, row["of"], first, row["doc_ids"][first:upto], sizes[first:upto], codes[ends[first] - sizes[first] : ends[upto - 1]], fields))
            first = upto
        del al, codes, segments
        give_back()
        return pa.Table.from_batches(out)

    return run


def _documents(al: Alignments, block: int, first: int, docs: list, sizes: np.ndarray, codes: np.ndarray, fields: list[str]) -> pa.RecordBatch:
    n = len(docs)
    doc = np.repeat(np.arange(n), sizes)
    bad = np.bincount(doc[~al.ok[codes]], minlength=n) > 0
    if bad.any():
        keep = ~bad[doc]
        doc, codes = doc[keep], codes[keep]
    total = lambda x: np.bincount(doc, weights=x[codes], minlength=n).astype(np.int64)
    edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
    text = al.text
    listed = codes.tolist()
    groups = ["".join([text[c] for c in listed[x:y]])[:-1] for x, y in zip(edges, edges[1:])]
    many = (al.links[1:] - al.links[:-1])[codes]
    at = np.repeat(al.links[codes] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    pair, times, of = al.pair[at], al.times[at], np.repeat(doc, many)
    by = np.argsort(of.astype(np.int64) << 32 | pair)
    pair, times, of = pair[by], times[by], of[by]
    new = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    times = np.add.reduceat(times, new) if len(new) else times
    offsets = pa.array(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32))
    columns = [pa.array(np.full(n, block)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(docs, pa.int64())]
    columns += [pa.array(total(x)) for x in (al.n_a, al.n_b, al.n_groups, al.n_links)]
    columns += [pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pair[new].astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))]
    return pa.RecordBatch.from_arrays(columns, fields)


def alignments(docs: DataFrame, path_a: str, path_b: str, groups: Column | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs`` (doc_id, text).

    ``groups`` is a text, ``a1,a2|b1;a3|b2,b3``: ids of A and B by group. Where less is kept of it, give an expression over the column
    ``groups``; it is applied before rows are stored. Null and empty texts, and those whose tokens don't give their bytes
    back (a literal U+2581, say), have zeros and an empty text of groups, and count nowhere. Each row counts as a document,
    repeated ids and texts too, and null ids stay; an empty table stays empty; other columns are left out.
    """
    b = piece_tokens(path_b)
    width = max(len(byte_tokens(path_a).bytes), len(b.bytes))
    if width > END:
        raise ValueError("ids must be below 65534")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(rows.mapInArrow(_blocks(b.cuts, buckets), BLOCKS), "align-blocks")
    dealt = blocks.select("block", F.explode("dealt").alias("d")).select("block", "d.n", "d.size", "d.packed", "d.bucket")
    each = dealt.repartition(buckets, "bucket").drop("bucket").mapInArrow(_undealt, "block long, place int, segment string")
    joined = each.sortWithinPartitions("segment").mapInArrow(_aligner(path_a, path_b), ALIGNED)
    whole = blocks.select(F.col("block").alias("of"), "doc_ids", "sizes", "codes", "n_codes")
    composed = joined.groupBy("block").cogroup(whole.groupBy("of")).applyInArrow(_compose(width), COMPOSED)
    kept = F.col("groups") if groups is None else groups
    pack = lambda x: F.transform(x, lambda v: v.cast("int"))
    composed = stored(composed.withColumn("groups", kept).withColumn("times", pack(F.col("times"))), "align-docs")
    dropped(blocks)
    held = composed.select("block", "place", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("block", "place", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = composed.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "align-counts")
    id_a = F.shiftright("pair", 16)
    top = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))  # at most one row an id of A
    counts = counts.withColumn("a", id_a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    sums = join_counted(held, counts, ["pair"], counts.count()).groupBy("block", "place").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return composed.join(sums, ["block", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def op13_token_alignment(spark, sf_dir) -> DataFrame:
    """Alignments of all documents; the text of groups is kept as its hash."""
    import public_tokenizers

    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest)
    return out.withColumnRenamed("groups", "groups_sha256")
