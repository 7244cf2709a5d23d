"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints: XXH64 (seed 42) of three-word shingles, a bit set if it is set in over half of them. Two
fingerprints link at `RADIUS` differing bits or fewer; documents with one fingerprint are one class, and classes
are connected over links.

Search, on distinct fingerprints: the 64 bits are grouped into m partitions, correlated bits together (greedily,
on a bounded sample). If two fingerprints differ in r bits or fewer, then for any thresholds t_i >= -1 with
sum t_i = r - m + 1 some partition differs in t_i bits or fewer (-1: not probed). Each fingerprint gets thresholds
of its own, by dynamic programming over partitions on the costs of probing and of the candidates estimated from
the sample's value counts; so a partition whose value is common is left out where others do. It then probes
every value within t_i of its own, and candidates are verified on all 64 bits in the join itself. The estimates
decide on cost only: every allocation finds all links. The sample's bound is `SAMPLE` fingerprints.

Copies never meet as documents: a fingerprint stands for all of them, and a link is made once, from the greater
fingerprint to the smaller. No bucket is ever gathered; the join may split a common value over tasks.

Defined cases: null text is empty; no words: fingerprint zero, linked like any other; fewer than three words: the
whole sequence is the shingle; null doc_ids are kept and never name a component unless nothing else does; rows repeated
whole are rows of one class each; a text of any length is hashed whole; an empty table gives an empty result; further
columns aren't read (`deduplicate` keeps them, whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, pack_row, small, small_batches, table, unpack_row
from .components import components
from .xxh64 import hashes, padded
from .xxh64_sql import xxh64

SEED, SHINGLE, RADIUS = 42, 3, 3
SAMPLE = 20_000
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
PROBE_COST, CANDIDATE_COST = 1.0, 0.1


def joined_words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes, one text after another (begin: each one's place, and the end of all) -> the same with A-Z as a-z and
    one space between words; each word's first place in it and the place behind it; each text's number of words."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.zeros(len(data) + 1, bool)
    edges[begin] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edges[1:-1]
    last[:-1] &= ~word[1:] | edges[1:-1]
    keep = word.copy()
    keep[:-1] |= word[1:]
    place = np.cumsum(keep) - 1
    low = np.where((data >= 65) & (data <= 90), data + 32, np.where(word, data, 32)).astype(np.uint8)
    counted = np.concatenate([[0], np.cumsum(first)])
    return low[keep], place[first], place[last] + 1, np.diff(counted[begin])


def ones(h: np.ndarray, n: np.ndarray, bits: Iterable[int] = range(8)) -> Iterator[tuple[int, np.ndarray]]:
    """For each run of n[i] > 0 hashes, in how many a bit is set: (bit, counts by run) for the bits b, 8 + b, ... 56 + b.

    Bits are counted in eight byte-wide lanes at once, in blocks of 255 hashes at most, which no lane overflows.
    """
    blocks = -(-n // 255)
    ends = np.cumsum(blocks)
    inside = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
    starts = np.repeat(np.cumsum(n) - n, blocks) + 255 * inside
    for bit in bits:
        lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), ends - blocks, axis=0, dtype=np.int64)
        for lane in range(8):
            yield 8 * lane + bit, counts[:, lane]


def majorities(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes: the number whose bits are those set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    some = np.nonzero(counts)[0]
    if len(some):
        n = counts[some]
        for bit, found in ones(h, n):
            out[some] |= (2 * found > n).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(data: np.ndarray, begin: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprints of texts that lie one after another."""
    text, first, behind, words = joined_words(data, begin)
    counts = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    of = np.repeat(np.cumsum(words) - words, counts)
    ends = np.cumsum(counts)
    start = of + np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    last = start + np.repeat(np.minimum(words, n), counts) - 1
    own = first[start]
    return majorities(hashes(padded(text), own, behind[last] - own, SEED), counts)


def with_fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp (as a signed long), text_hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            begin = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at, found = 0, []
            while at < len(texts):  # about SLICE bytes at once, one text at least
                to = max(at + 1, int(np.searchsorted(begin, begin[at] + SLICE, side="right")) - 1)
                found.append(fingerprints(data[begin[at] : begin[to]], begin[at : to + 1] - begin[at], n))
                at = to
            fps = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(each, "doc_id long, fp long, text_hash long")


def bit_groups(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, correlated bits together."""
    bits = (sample.view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(float) - bits.mean(axis=0) if len(sample) else np.zeros((1, 64))
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    near = np.abs(x.T @ x / norm[:, None] / norm[None, :])
    left, groups = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        start = max(left, key=lambda b: (sum(near[b][c] for c in left), -b))
        group = [start]
        left.discard(start)
        while len(group) < size:
            nxt = max(left, key=lambda b: (near[b][group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def partitions_for(n: int, radius: int = RADIUS) -> int:
    """How many partitions cost least for n fingerprints, if their bits were even."""
    best = {}
    for m in range(2, radius + 2):
        spare, width = radius - m + 1, 64 / m
        each = [spare // m + (i < spare % m) for i in range(m)]
        probes = sum(comb(int(width), j) for t in each for j in range(t + 1))
        best[m] = probes * PROBE_COST + m + n * probes / 2**width * CANDIDATE_COST
    return min(best, key=best.get)


class Index:
    """The partitions' masks, and the estimated costs on which thresholds are allotted."""

    def __init__(self, sample: np.ndarray, total: int, radius: int = RADIUS):
        self.radius, self.total, self.m = radius, max(total, 1), partitions_for(total, radius)
        self.groups = bit_groups(sample, self.m)
        self.masks = [sum(1 << b for b in g) for g in self.groups]
        self.sample = len(sample)
        self.counts = [np.unique(sample.view(np.uint64) & np.uint64(k), return_counts=True) for k in self.masks]

    def estimate(self, i: int, values: np.ndarray) -> np.ndarray:
        """Fingerprints that share a partition's value: the sample's count scaled up, or what is even."""
        known, counts = self.counts[i]
        even = self.total / 2.0 ** len(self.groups[i])
        if not len(known):
            return np.full(len(values), even)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        seen = np.where(known[at] == values, counts[at], 0)
        return np.maximum(np.where(seen > 1, seen, 0) * (self.total / self.sample), even)

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """Thresholds by partition for each fingerprint: dynamic programming over the sum spent so far."""
        n, most = len(fps), self.radius - self.m + 1
        top = max(1, most)  # no partition gets more than this
        sums = range(-self.m, self.m * top + 1)
        best = {0: np.zeros(n)}
        choice: list[dict[int, np.ndarray]] = []
        for i in range(self.m):
            own = fps & np.uint64(self.masks[i])
            cost = {-1: np.zeros(n)}
            spent = np.zeros(n)
            for t in range(top + 1):
                new = [sum(1 << b for b in c) for c in combinations(self.groups[i], t)]
                for f in new if t < 2 else []:
                    spent = spent + PROBE_COST + CANDIDATE_COST * self.estimate(i, own ^ np.uint64(f))
                if t >= 2:
                    spent = spent + len(new) * (PROBE_COST + CANDIDATE_COST * self.total / 2.0 ** len(self.groups[i]))
                cost[t] = spent
            nxt: dict[int, np.ndarray] = {}
            took: dict[int, np.ndarray] = {}
            for s in sums:
                for t, c in cost.items():
                    if s - t in best:
                        v = best[s - t] + c
                        if s not in nxt:
                            nxt[s], took[s] = v, np.full(n, t)
                        else:
                            better = v < nxt[s]
                            nxt[s], took[s] = np.where(better, v, nxt[s]), np.where(better, t, took[s])
            best = nxt
            choice.append(took)
        out = np.empty((n, self.m), dtype=np.int64)
        s = np.full(n, most)
        for i in range(self.m - 1, -1, -1):
            for k in np.unique(s):
                out[s == k, i] = choice[i][k][s == k]
            s = s - out[:, i]
        return out


def links(distinct: DataFrame, total: int, radius: int = RADIUS) -> DataFrame:
    """distinct: fp -> a, b: every pair of fingerprints, a > b, that differ in `radius` bits or fewer (maybe repeated)."""
    spark = distinct.sparkSession
    rows = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    index = Index(np.array([r[0] for r in rows], dtype=np.int64), total, radius)
    known = spark.sparkContext.broadcast(index)

    def probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx = known.value
        for f in frames:
            fps = f.fp.to_numpy(dtype=np.int64).view(np.uint64)
            wanted = idx.thresholds(fps)
            for i in range(idx.m):
                own = fps & np.uint64(idx.masks[i])
                for t in range(int(wanted[:, i].max(initial=-1)) + 1):
                    take = wanted[:, i] >= t
                    for bits in combinations(idx.groups[i], t):
                        flip = np.uint64(sum(1 << b for b in bits))
                        yield pd.DataFrame({"part": np.int32(i), "value": (own[take] ^ flip).view(np.int64), "a": fps[take].view(np.int64)})

    masks = F.array(*[F.lit(k - (1 << 64) if k >> 63 else k).cast("long") for k in index.masks])
    held = distinct.select(F.col("fp").alias("b"), F.posexplode(masks).alias("part", "mask"))
    held = held.select("b", "part", F.col("b").bitwiseAND(F.col("mask")).alias("value"))
    asked = distinct.mapInPandas(probes, "part int, value long, a long")
    near = (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    found = asked.join(held, (asked.part == held.part) & (asked.value == held.value) & near)
    return found.select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, text_hash, root, component_id of every row of docs (doc_id, text). root names the component."""
    fps = materialize(with_fingerprints(docs, shingle), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    total = classes.count()
    roots = components(links(classes.select("fp"), total, radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(named.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return fps.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id (null first), all columns as they were."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component; `rows`: doc_id, text_hash, root of every row of docs."""
    own = docs.columns
    no_id = F.lit(-(1 << 63))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", no_id))
    # How many rows share a component's first id and text; more than one only where rows are repeated.
    per = rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = per.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("k"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("__k"), F.col("k.text_hash").alias("__t"), F.col("k.n").alias("__n")), "simhash-kept")
    marked = pack_row(docs, "doc_id", "text").withColumn("__k", F.coalesce(F.col("doc_id").cast("long"), no_id)).withColumn("__t", F.xxhash64("text"))
    once = marked.join(kept.where("__n = 1").select("__k", "__t"), ["__k", "__t"], "left_semi")
    repeated = kept.where("__n > 1").select("__k", "__t")
    n = repeated.count()
    if n:
        again = marked.join(small(repeated, n), ["__k", "__t"], "left_semi").dropDuplicates(["__k", "__t"])
        once = once.unionByName(again)
    return unpack_row(once, own, "doc_id", "text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM d
), {xxh64("sh", "hs", SEED)}, ones AS (
  SELECT rid, b, 2 * sum((h >> b::UBIGINT) & 1) > count(*) AS most
  FROM sh JOIN hs USING (s), unnest(range(64)) AS u(b) GROUP BY rid, b
), prints AS (
  SELECT rid, bit_or(CASE WHEN most THEN (1::UHUGEINT << b::UHUGEINT)::UBIGINT ELSE 0::UBIGINT END) AS fp FROM ones GROUP BY rid
), f AS (
  SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN prints USING (rid)
), classes AS (
  SELECT fp, min(doc_id) AS least FROM f GROUP BY fp
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BIT) <= 3
), reach AS (
  SELECT fp AS a, fp AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), named AS (
  SELECT a AS fp, min(least) AS component_id FROM reach JOIN classes ON classes.fp = reach.b GROUP BY a
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN named USING (fp)
"""

QUERIES = {"op9_simhash": op9_simhash}
SQL = {"op9_simhash": OP9_SQL}
