"""Packing by lexical retrieval.

Documents are dealt to shards of a BM25 inverted index by lexical affinity: each is a point of `DIMS` random signed sums
of its words, a k-d tree over a sample's points (`SAMPLE` documents, about) orders all points so that texts of like words
lie together, and the tree's leaves, in that order, are cut into shards of about `SHARD_TOKENS` tokens. A leaf that
holds more than its share (say copies of one text) is dealt over several tasks. Shards are cut while rows stream past,
so none is larger, however many documents a leaf has.

A seed document opens a window; its unused neighbours in the shard, best BM25 score first, fill it, and
without neighbours left the next unused document does. What doesn't fit is cut: the rest of the cut document is
the next window's seed. So windows are full but for a shard's last one, which is split into sequences whose lengths
are powers of two and which need no padding: no sequence is padded at all.

Queries are all terms of the seed; terms of one document alone are left out, as they find nothing. A seed's neighbours
are all unused documents that share a term with it, or as many of the best as a window has tokens: each document has
one token at least, so no more can enter. Tokens are looked up by white-space separated chunk: the tokenizer never
joins across white space, so chunks can be kept in a bounded table and only new ones are encoded. Past `kept` entries
those go that no later slice of text has met, as most chunks stand in one text alone.

Defined cases: null text is empty and has the end id alone; a text longer than a shard is one; a null doc_id is packed
too; rows of one doc_id are packed each, rows repeated whole too; equal scores go by the order of leaf, doc_id and text;
an empty table has no pieces; further columns aren't read. Reruns agree: a shard's rows are ordered before they are
packed, and how rows are dealt follows from their contents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import Tree
from .common import in_slices, slots_for, small_batches, table, text_slices
from .memory import trim
from .near_copies import mixed
from .simhash import ones

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1_100_000
#: Bytes of text of a task, about; leaves of the k-d tree to a task.
TASK_BYTES, LEAVES = 12_000_000, 4
DIMS, SAMPLE = 24, 4_000
#: Characters of text that are encoded at once.
SLICE = 1 << 20
K1, B = 1.2, 0.75
#: Postings of a list that is added up with others.
SHORT = 64
#: Chunks that a worker keeps.
KEPT = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STATE: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Numbers(dict):
    """chunk -> its number: one that is asked for the first time gets the next number and is put on `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Chunks:
    """Ids and a term number for each chunk of a text, kept by chunk.

    Chunks are kept in ASCII lower case, as the tokenizer lowers all text. A mark between an ASCII letter and white
    space is a token run of its own, so it is a chunk of its own.
    """

    END = b"\n"  # no chunk: it stands for the end id
    #: Stands between chunks that are encoded as one text.
    BETWEEN = "~"
    #: The mark first: so it is what the search runs for.
    MARK = re.compile(rb"[.,;:!?](?<=[a-z].)(?=[ \n])")

    def __init__(self, path: str, end_id: int, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id, self.kept = end_id, kept
        self.between = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.index = Numbers()
        self.ids, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32)
        self.start, self.term = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)
        self.met = np.zeros(1 << 16, bool)  # by a later slice than the one that brought the chunk
        self.used = 0
        self.add([self.END], np.array([self.end_id], np.uint32), np.array([1]))

    def add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = np.array([self.index[c] for c in chunks], np.int64)
        self.index.new = []
        self.store(at, chunks, ids, sizes)

    def store(self, at: np.ndarray, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """at: the chunks' numbers."""
        while len(self.size) < len(self.index):
            self.size, self.start, self.term, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start, self.term, self.met))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.term[at] = np.fromiter(map(zlib.crc32, chunks), np.uint32, len(chunks))
        self.used += len(ids)

    def shrink(self) -> None:
        """Keep the chunks that were met again, the longest known first, at most half of `kept`; to stay they must be met anew."""
        keep = np.nonzero(self.met[1 : len(self.index)])[0][: self.kept // 2] + 1
        chunks, sizes = list(self.index), self.size[keep]
        ids = self.ids[np.repeat(self.start[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        self.clear()
        self.add([chunks[i] for i in keep.tolist()], ids, sizes)

    def learn(self, first: int) -> None:
        """Encode the new chunks, which are numbered from `first`."""
        chunks, self.index.new = self.index.new, []
        texts = b" ".join(chunks).decode("utf-8", "replace").split(" ")
        plain = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        for own, cut in ((np.flatnonzero(plain), self._cut_words), (np.flatnonzero(~plain), self._cut_between)):
            for begin in range(0, len(own), 20_000):
                at = own[begin : begin + 20_000].tolist()
                part = [texts[i] for i in at]
                ids, sizes = cut(part) or self._each(part)
                self.store(np.array(at) + first, [chunks[i] for i in at], ids, sizes)

    def _cut_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Letters alone are one run each, and a run's last token says so: many words are encoded as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(texts) and len(ids) == ends[-1] else None

    def _cut_between(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Other chunks are encoded as one text with a sign between them that has one id, which no chunk has."""
        if len(self.between) != 1:
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        signs = np.flatnonzero(ids == self.between[0])
        if len(signs) != len(texts) - 1:
            return None
        return np.delete(ids, signs), np.diff(np.concatenate([[-1], signs, [len(ids)]])) - 1

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    @classmethod
    def of(cls, text: str | None) -> list[bytes]:
        return cls.MARK.sub(rb" \g<0>", text.encode("utf-8", "surrogatepass").lower()).split() if text else []  # bytes: A-Z and the six ASCII spaces only

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids, each text's end id after it; ids by text; all texts' terms; terms by text."""
        every: list[bytes] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.of(t)
            counts[i] = len(own)
            every += own
            every.append(self.END)
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        if self.index.new:
            self.learn(known)
        self.met[at[at < known]] = True
        sizes = self.size[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(total)]
        last = np.cumsum(counts + 1) - 1
        lengths = np.diff(ends[last], prepend=0)
        word = np.ones(len(every), bool)
        word[last] = False
        terms = self.term[at[word]]
        if len(self.index) > self.kept:
            self.shrink()
        return ids, lengths, terms, counts


def chunks_of(path: str, end_id: int, kept: int = KEPT) -> Chunks:
    if _STATE.get("key") != (path, end_id, kept):
        _STATE.update(key=(path, end_id, kept), chunks=Chunks(path, end_id, kept))
    return _STATE["chunks"]


def free() -> None:
    """Let go of the table of chunks: a worker that encoded before needs it no longer when it packs."""
    _STATE.clear()
    trim()


class Bm25:
    """An inverted index over one shard's documents."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, k1: float = K1, b: float = B):
        """All documents' terms, one after another; each document's number of them."""
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        pairs = np.sort(terms.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64))
        first = np.nonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))[0] if len(pairs) else np.zeros(0, np.int64)
        tf = np.diff(first, append=len(pairs))
        pairs = pairs[first]
        term, doc = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(term), bool)
        new[1:] = term[1:] != term[:-1]
        place = np.cumsum(new) - 1
        df = np.bincount(place) if len(place) else np.zeros(0, np.int64)
        shared = df[place] > 1
        doc, tf, df = doc[shared], tf[shared], df
        place = place[shared]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * sizes / max(1.0, sizes.mean() if n else 1.0))
        self.weight = (idf[place] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.doc = doc
        # Postings lie by term; a document's own entries are found by a second order.
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        self.begin = np.concatenate([np.nonzero(first)[0], [len(place)]])
        self.list_of = np.cumsum(first) - 1
        self.by_doc = np.lexsort((-self.weight, doc))
        self.doc_begin = np.searchsorted(doc[self.by_doc], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray, most: int = WINDOW) -> list[int]:
        """The `most` best unused documents that share terms with the seed, best score first; ties to the smaller place."""
        lists = self.list_of[self.by_doc[self.doc_begin[seed] : self.doc_begin[seed + 1]]]
        begin, sizes = self.begin[lists], self.begin[lists + 1] - self.begin[lists]
        # Short lists are added up together, long ones each in place.
        short = sizes <= SHORT
        own = sizes[short]
        at = np.repeat(begin[short] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        scores = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n).astype(np.float32)
        for a, b in zip(begin[~short].tolist(), (begin + sizes)[~short].tolist()):
            scores[self.doc[a:b]] += self.weight[a:b]
        scores[~unused] = 0
        top = np.nonzero(scores)[0]
        if len(top) > most:
            top = top[scores[top] >= np.partition(scores[top], -most)[-most]]
        return top[np.lexsort((top, -scores[top]))][:most].tolist()


def arrange(terms: np.ndarray, counts: np.ndarray, lengths: list[int], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """Cuts of documents (place, start, length) in the order in which they fill windows, one after another."""
    n = len(lengths)
    index, unused, nxt, room = Bm25(terms, counts), np.ones(n, bool), 0, window
    queue: list[int] = []
    while True:
        # Neighbours are asked for by the document that opens a window, or that is no neighbour of the one before.
        while nxt < n and not unused[nxt]:
            nxt += 1
        if not queue and nxt == n:
            return
        near = bool(queue)
        doc = queue.pop() if near else nxt
        unused[doc] = False
        at, opened = 0, room == window
        while at < lengths[doc]:
            take = min(room, lengths[doc] - at)
            yield doc, at, take
            at, room = at + take, room - take
            if not room:
                room, opened = window, at < lengths[doc]
        if opened or not near:
            queue = index.neighbours(doc, unused, window)[::-1]


def sequences(cuts: Iterator[tuple[int, int, int]], total: int, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, start, length, sequence, offset): the windows; the rest of all ids in sequences of powers of two."""
    full, rest = divmod(total, window)
    sizes = [window] * full + [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]
    seq, offset = 0, 0
    for doc, start, length in cuts:
        while length:
            take = min(length, sizes[seq] - offset)
            yield doc, start, take, seq, offset
            start, length, offset = start + take, length - take, offset + take
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0


def pack_shard(ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> dict[str, list]:
    """Pieces of one shard's documents, by their place; all ids and all terms lie one document after another."""
    begin = (np.cumsum(lengths) - lengths).tolist()
    lengths, data = lengths.tolist(), memoryview(ids.astype("<u4").tobytes())
    out: dict[str, list] = {c: [] for c in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset")}
    for doc, start, length, seq, offset in sequences(arrange(terms, counts, lengths, window), len(ids), window):
        at = 4 * (begin[doc] + start)
        for c, v in zip(out, (doc, start, length, zlib.crc32(data[at : at + 4 * length]), lengths[doc], seq, offset)):
            out[c].append(v)
    return out


def directions(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each document's point: the signed sums of its terms along `DIMS` random directions, at length 1."""
    out, some = np.zeros((len(counts), DIMS)), np.nonzero(counts)[0]
    if len(some):
        n = counts[some]
        for j, (_, found) in enumerate(ones(mixed(terms.astype(np.uint64) + np.uint64(1)), n, range(DIMS // 8))):
            out[some, j] = 2 * found - n
    return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


class Layout:
    """Which task gets a document: the leaves of a k-d tree, from left to right, cut into tasks of equal weight."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, parts: int):
        self.tree = Tree(points, max(1, len(points) // (parts * LEAVES)), tight=False)
        held = np.bincount(self.tree.leaf_of(points), weights=weights, minlength=len(self.tree.begin) - 1)
        share = held.sum() / parts
        before = np.cumsum(held) - held
        self.subs = np.where(held > 1.5 * share, np.ceil(held / share), 1).astype(np.int64)
        self.first = np.minimum(np.where(self.subs > 1, before, before + held / 2) // share, parts - self.subs).clip(0).astype(np.int64)

    def place(self, points: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf = self.tree.leaf_of(points)
        return self.first[leaf] + salt % self.subs[leaf], leaf


def layout(docs: DataFrame, rows: int, parts: int) -> Layout:
    """docs: text, key -> how they are dealt, from the documents whose key is divisible by rows / SAMPLE."""

    def point(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            every = [[zlib.crc32(c) for c in Chunks.of(t if isinstance(t, str) else None)] for t in f["text"]]
            points = directions(np.array([c for x in every for c in x], np.uint32), np.array([len(x) for x in every], np.int64))
            yield pd.DataFrame({"point": [p.tobytes() for p in points], "weight": f["weight"].astype(float)})

    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 10).cast("double")
    some = docs.where(F.pmod("key", F.lit(max(1, rows // SAMPLE))) == 0)
    some = some.groupBy("key").agg(F.first("text").alias("text"), F.sum(size).alias("weight")).select("text", "weight")
    got = some.mapInPandas(point, "point binary, weight double").toPandas().sort_values(["point", "weight"], ignore_index=True)
    points = np.frombuffer(b"".join(got["point"]), float).reshape(-1, DIMS) if len(got) else np.zeros((1, DIMS))
    return Layout(points, got["weight"].to_numpy(float) if len(got) else np.ones(1), parts)


def pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, task_bytes: int = TASK_BYTES, path: str | None = None, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """Pieces of all documents (doc_id, text): where each lies in which sequence. kept: chunks in a worker's table."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"))
    total, rows = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 10), F.lit(0)), F.count(F.lit(1))).first()
    parts = in_slices(total, task_bytes)
    deal = spark.sparkContext.broadcast((layout(own, rows, parts), np.array(slots_for(spark, parts))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, slots = deal.value
        trim()  # of what other operators' tasks left in this worker
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            for own in text_slices(texts, SLICE):
                ids, lengths, terms, counts = chunks_of(path, end_id, kept).encode(texts[own])
                doc_id, key = (batch.column(i).slice(own.start, own.stop - own.start) for i in (0, 2))
                part, leaf = how.place(directions(terms, counts), (key.to_numpy().view(np.uint64) >> np.uint64(1)).astype(np.int64))
                columns = [pa.array(slots[part]), pa.array(part), pa.array(leaf), doc_id, key, binaries(ids, lengths), binaries(terms, counts)]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "part", "leaf", "doc_id", "key", "ids", "terms"])
        trim()

    def arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, size = None, 0, [], 0
        free()

        def flush() -> pa.RecordBatch:
            nonlocal first
            ids, terms = (np.frombuffer(b"".join([x[i] for x in held]), np.uint32) for i in (1, 2))
            lengths, counts = (np.array([len(x[i]) // 4 for x in held], np.int64) for i in (1, 2))
            out = pack_shard(ids, lengths, terms, counts, window)
            sequence = np.array(out["sequence"], np.int64) + first
            first = int(sequence.max()) + 1
            columns = [pa.array([held[d][0] for d in out["doc"]], pa.int64()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")), pa.array((part << 32) | sequence), pa.array(out["offset"], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for at, doc_id, ids, terms in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (at != part or size >= shard_tokens):
                    yield flush()
                    held, size = [], 0
                if at != part:
                    part, first = at, 0
                held.append((doc_id, ids, terms))
                size += len(ids) // 4
        if held:
            yield flush()
        held.clear()
        trim()

    dealt = own.mapInArrow(encode, "slot long, part long, leaf long, doc_id long, key long, ids binary, terms binary")
    dealt = dealt.repartition(parts, "slot").sortWithinPartitions("part", "leaf", "doc_id", "key").select("part", "doc_id", "ids", "terms")
    return dealt.mapInArrow(arranged, SCHEMA)


def binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary per document of 4-byte values that lie one document after another."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values.astype("<u4").tobytes())]).cast(pa.binary())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
