"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words and word beginnings (hashed), as one labels' column marks texts.
Every sentence of the training texts that holds an identity term is met again with the term swapped for each other of
its group, and the square of the change of the score (as a logit) is part of the loss, weighted `CF_WEIGHT`. So a mere
mention of a group earns no score, even where the labelled rows happen to mention it in toxic texts more often. What a
swap changes are few features, the same in many sentences: swaps are counted by what they change, none is left out.

It is fitted on a bounded sample of the labelled rows: `MAX_TOXIC` and `MAX_CLEAN` rows, those with the least hash
of doc_id, weighed back to the labels' shares. Features are extracted on the executors; the driver gets hashed
features of these rows only, and fits those that `MIN_COUNT` rows have at least and whose toxic share is `MIN_Z`
standard deviations from the sample's, and the identity terms' own. Every whole text is then scored.

Labels, language, source and id are never inputs of a score. Defined cases: null text is empty; an empty text gets
the bias; a very long text is one row like any other; a null doc_id counts as the empty string in the fold; rows
repeated whole are scored each, and a labelled doc_id in several rows counts once, by its text of least hash; a
doc_id labelled more than once is toxic if any label says so; null and other labels are left out; features of equal
weight stay all; without labels of both kinds, the score is the share of toxic labels (0.0 without any); an empty
table gives an empty result; further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, materialize, pack_row, small_batches, table, text_slices
from .memory import trimmed

MAX_TOXIC, MAX_CLEAN = 3000, 6000
HASH_BITS = 22
MIN_COUNT, MIN_Z = 4, 2.0
L2, CF_WEIGHT, ROUNDS = 2e-5, 1.0, 600
BEGINNINGS = (4, 5, 6)
#: Chunks, and their characters, whose features a task keeps at most.
KNOWN, KNOWN_CHARS = 200_000, 8_000_000
#: Characters of text that are scored at once.
SLICE = 1 << 20
#: Groups of identity terms; terms of one group are swapped for one another.
IDENTITY = (
    ("he", "she", "they"),
    ("him", "her", "them"),
    ("his", "hers", "their"),
    ("er", "sie"),
    ("il", "elle"),
    ("ils", "elles"),
    ("él", "ella"),
    ("ellos", "ellas"),
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "turkish", "polish"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
)
#: Digits and signs that stand for letters inside words.
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def features_of(chunk: str) -> tuple[int, ...]:
    """Hashed features of one white-space separated chunk, which is in lower case."""
    parts = [p for p in re.split(r"[\W_]+", chunk) if p] if re.search(r"\w[\W_]+\w", chunk) else []
    whole = _EDGE.sub("", chunk)
    names = {whole, *parts}
    if any(c in "013457@$!" for c in chunk) and any(c.isalpha() for c in chunk):
        names.add(_EDGE.sub("", chunk.translate(LOOKALIKE)))
    names.discard("")
    keys = set()
    for w in names:
        keys.add(f"w{w}")
        keys.update(f"b{w[:n]}" for n in BEGINNINGS if len(w) > n)
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS) for k in keys)


_W, _B = zlib.crc32(b"w"), zlib.crc32(b"b")


def weighing(chunk: str, place: dict[int, int]) -> list[int]:
    """The places of a chunk's features, of those that have one: `features_of`, with a short way for plain words."""
    word = chunk.rstrip(".,;:?")
    if not word.isalpha():
        return [place[k] for k in features_of(chunk) if k in place]
    raw = word.encode()
    if not word.isascii():
        keys = [zlib.crc32(raw, _W), *(zlib.crc32(word[:end].encode(), _B) for end in BEGINNINGS if len(word) > end)]
        return [place[k >> (32 - HASH_BITS)] for k in keys if k >> (32 - HASH_BITS) in place]
    keys, n, crc, at = [zlib.crc32(raw, _W)], len(raw), _B, 0
    for end in BEGINNINGS:
        if n <= end:
            break
        crc, at = zlib.crc32(raw[at:end], crc), end
        keys.append(crc)
    return [place[k >> (32 - HASH_BITS)] for k in keys if k >> (32 - HASH_BITS) in place]


def features(text: str | None) -> set[int]:
    out: set[int] = set()
    for chunk in set((text or "").lower().split()):
        out.update(features_of(chunk))
    return out


def counterfactuals(text: str | None, groups: Iterable[tuple[str, ...]] = IDENTITY) -> Counter:
    """For each sentence, identity term in it and other term of its group: (features lost, features won) by the swap."""
    group_of = {t: g for g in groups for t in g}
    out: Counter = Counter()
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        words = sentence.lower().split()
        marked = [(i, t) for i, w in enumerate(words) if (t := w if w in group_of else _EDGE.sub("", w)) in group_of]
        if not marked:
            continue
        every = Counter(k for w in set(words) for k in features_of(w))
        times = Counter(words)
        for i, term in marked:
            # Of a word that stands once, the features that no other word of the sentence has go with it.
            own = set(features_of(words[i])) if times[words[i]] == 1 else set()
            gone = {k for k in own if every[k] == 1}
            for other in group_of[term]:
                if other != term:
                    new = set(features_of(words[i].replace(term, other)))
                    lost, won = gone - new, {k for k in new if k not in every}
                    if lost or won:
                        out[as_bytes(lost), as_bytes(won)] += 1
    return out


def as_bytes(found: set[int]) -> bytes:
    return np.array(sorted(found), "<i4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


class Model:
    """Weights by hashed feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.place = {k: i for i, k in enumerate(sorted(weights))}
        self.values = np.array([weights[k] for k in sorted(weights)])
        self.clear()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def clear(self) -> None:
        """Forget the chunks met so far: of each, the features that weigh anything, one chunk after another."""
        self.index: dict[str, int] = {}
        self.size, self.start = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)
        self.flat, self.used, self.chars = np.zeros(1 << 12, np.int64), 0, 0

    def learn(self, chunks: list[str]) -> None:
        place = self.place
        found = [weighing(c, place) for c in chunks]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        first, last, used = len(self.index), len(self.index) + len(chunks), self.used + int(sizes.sum())
        while len(self.size) < last:
            self.size, self.start = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.start))
        while len(self.flat) < used:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = [k for x in found for k in x]
        self.size[first:last] = sizes
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.index.update(zip(chunks, range(first, last)))
        self.used, self.chars = used, self.chars + sum(map(len, chunks))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        every: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = t.lower().split() if t else []
            counts[i] = len(own)
            every += own
        if len(self.index) > KNOWN or self.chars > KNOWN_CHARS:
            self.clear()
        new = set(every).difference(self.index)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        weighs = np.nonzero(self.size[at])[0]
        doc, at = np.repeat(np.arange(len(texts)), counts)[weighs], at[weighs]
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        feature = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        # A feature counts once a text, and is added in one order.
        width = max(1, len(self.values))
        found = np.unique(np.repeat(doc, sizes) * width + feature)
        return self.bias + np.bincount(found // width, weights=self.values[found % width] if len(found) else None, minlength=len(texts))

    def logit(self, text: str | None) -> float:
        return float(self.logits([text])[0])

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = [t if isinstance(t, str) else None for t in texts]
        z = np.concatenate([np.zeros(0), *(self.logits(texts[s]) for s in text_slices(texts, SLICE))])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, int]], cf_weight: float = CF_WEIGHT) -> Model:
    """rows: hashed features of each text; pairs: features lost and won by a swap, and how many swaps do that."""
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    if not 0 < share < 1:
        return Model({}, float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    # Counted row by row over the hash range, so that no copy of all features is ever held.
    counts, toxic = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
    for r, y in zip(rows, labels):
        counts[r] += 1
        if y:
            toxic[r] += 1
    # Which features are told apart best from chance, by the z-score of their toxic share in the sample.
    rate = labels.mean()
    names = np.nonzero(counts)[0]
    z = np.abs(toxic[names] - counts[names] * rate) / np.sqrt(counts[names] * rate * (1 - rate))
    z[counts[names] < MIN_COUNT] = 0
    # Identity terms stay, whatever they tell: their weights are what swaps hold down.
    swapped = np.unique(np.concatenate([x for a, b, _ in pairs for x in (a, b)])) if pairs else np.zeros(0, np.int64)
    names = names[(z >= MIN_Z) | np.isin(names, swapped)]
    column = np.full(1 << HASH_BITS, -1, np.int32)
    column[names] = np.arange(len(names))
    cols = [column[r] for r in rows]
    cols = [c[c >= 0] for c in cols]
    col, row, n = np.concatenate(cols), np.repeat(np.arange(len(rows)), [len(c) for c in cols]), len(names)
    held = [(i, sign, column[own][column[own] >= 0]) for i, (a, b, _) in enumerate(pairs) for sign, own in ((1.0, a), (-1.0, b))]
    pc = np.concatenate([c for _, _, c in held]).astype(np.int64) if held else np.zeros(0, np.int64)
    pr = np.repeat([i for i, _, _ in held], [len(c) for _, _, c in held]).astype(np.int64)
    pv = np.repeat([s for _, s, _ in held], [len(c) for _, _, c in held])
    often = np.array([c for _, _, c in pairs], float)
    often = 2 * cf_weight * often / max(1.0, often.sum())
    w, b = np.zeros(n), float(np.log(share / (1 - share)))
    share_of = weights / weights.sum()
    scale = 0.25 * np.bincount(col, weights=share_of[row], minlength=n) + L2
    if len(pairs):
        scale += np.bincount(pc, weights=often[pr], minlength=n)
    # Accelerated gradient steps, scaled by feature.
    look, look_b, t, step = w.copy(), b, 1.0, 0.25
    for _ in range(ROUNDS):
        score = look_b + np.bincount(row, weights=look[col], minlength=len(rows))
        gap = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels) * share_of
        grad = np.bincount(col, weights=gap[row], minlength=n) + L2 * look
        if len(pairs):
            change = np.bincount(pr, weights=pv * look[pc], minlength=len(pairs))
            grad += np.bincount(pc, weights=pv * (often * change)[pr], minlength=n)
        new, new_b = look - step * grad / np.sqrt(scale * scale.max()) / max(1.0, scale.max()), look_b - step * 4 * gap.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return Model({int(k): float(v) for k, v in zip(names, w) if abs(v) > 1e-6}, float(b))


def train(docs: DataFrame, labels: DataFrame, groups: Iterable[tuple[str, ...]] = IDENTITY, cf_weight: float = CF_WEIGHT) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that aren't held out are read for labels."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    assert MAX_TOXIC + MAX_CLEAN <= BROADCAST_ROWS
    picked = small_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(some[0].union(some[1])), "doc_id")
    groups = tuple(groups)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, changes = [], []
            for text in b.column("text").to_pylist():
                own.append(as_bytes(features(text)))
                changes.append([{"lost": x, "won": y, "n": n} for (x, y), n in counterfactuals(text, groups).items()])
            swap = pa.list_(pa.struct([("lost", pa.binary()), ("won", pa.binary()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "text_hash")), pa.array(own, pa.binary()), pa.array(changes, swap)], names=["doc_id", "toxic", "text_hash", "own", "changes"])

    picked = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"), "text_hash")
    got = picked.mapInArrow(trimmed(extract), "doc_id long, toxic int, text_hash long, own binary, changes array<struct<lost:binary,won:binary,n:long>>")
    # Rows of one labelled id: the text of least hash stands for it; each task passes on one.
    got = got.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "own", "changes"), "text_hash").alias("x")).select("doc_id", "x.*")
    got = materialize(got, "toxicity-sample")
    swaps = got.select(F.explode("changes").alias("c")).groupBy("c.lost", "c.won").agg(F.sum("c.n").alias("n")).collect()
    pairs = [(from_bytes(bytes(r["lost"])), from_bytes(bytes(r["won"])), r["n"]) for r in sorted(swaps, key=lambda r: (bytes(r["lost"]), bytes(r["won"])))]
    got = got.select("doc_id", "toxic", "own").toPandas().sort_values("doc_id", kind="stable", ignore_index=True)
    y = got["toxic"].to_numpy(float)
    share = {k: totals.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return fit([from_bytes(x) for x in got["own"]], y, np.array([share[int(v)] for v in y]), pairs, cf_weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = pack_row(small_batches(docs), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text").to_pylist()))], names=[*b.schema.names, "__score"])
        model.clear()

    schema = T.StructType([*packed.schema.fields, T.StructField("__score", T.DoubleType())])
    out = packed.mapInArrow(trimmed(each), schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns], "__score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
