"""Counting a table of patterns in a table of texts, overlapping occurrences too, in one pass over the texts.

Two plans that share no code:

* `count_by_automaton`: the patterns become one automaton (trie, failure links and output links, as flat arrays), which is
  sent to the tasks as long as its tables fit in `TABLE_BYTES`; patterns that don't fit go into further automata, each a
  pass of its own. A task reads a batch of texts in step: every text is cut into stretches of equal length that overlap by
  the longest pattern, and one look-up moves all stretches on by a character. A state's output links then give every
  pattern that ends there.
* `count_by_hash_join`: windows of each pattern length are hashed by differences of running sums, and the hashes are joined
  to those of the patterns; a pair counts if the window is the pattern. Neither side is broadcast, so patterns may be as
  many as texts. A bitmap of the patterns' hashes, of fixed size, drops most windows before the shuffle; windows are added
  up per batch and text groups, and both sides are salted where one window may be very common.

Both give, per group of texts, pattern, occurrences and documents (rows of the table that hold it). Patterns are distinct strings;
null and empty ones are never found. Null and empty texts hold nothing. Texts of any length are read whole. An empty table
on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An automaton's table of moves at most.
TABLE_BYTES = 32 << 20
#: Characters of a stretch, and of the texts that are read in step.
STRETCH, SLICE = 2_048, 4 << 20
#: Characters that are hashed end to end.
HASHED = 1 << 18
#: Patterns that are brought to the driver to build automata; more are counted by the join.
MOST_PATTERNS = 200_000
BITMAP_BITS = 24
SALTS = 16


class Automaton:
    """Patterns as flat arrays: `move[state * classes + class]`, `link` (the next state with output), `ends` (the pattern
    that ends in a state, or -1), and the class of each character that patterns use (0: any other)."""

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.longest = max(map(len, patterns), default=0)
        self.chars = np.unique(np.frombuffer("".join(patterns).encode("utf-32-le"), "<u4"))
        self.classes = len(self.chars) + 1
        own = [self.classify(np.frombuffer(p.encode("utf-32-le"), "<u4")).tolist() for p in patterns]
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, p in enumerate(own):
            at = 0
            for c in p:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = k
        n = len(children)
        self.ends, self.link, fail = np.array(ends, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        move = np.zeros((n, self.classes), np.int32)
        level = [0]
        while level:  # breadth first: a state's failure is nearer to the root, so its moves are known
            below = []
            for s in level:
                f = int(fail[s])
                if s:
                    move[s] = move[f]
                    self.link[s] = f if self.ends[f] >= 0 else self.link[f]
                for c, t in children[s].items():
                    fail[t] = move[f, c] if s else 0
                    move[s, c] = t
                    below.append(t)
            level = below
        self.move = move.reshape(-1)
        self.output = (self.ends >= 0) | (self.link > 0)

    def classify(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.chars):
            return np.zeros(len(codes), np.int32)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0).astype(np.int32)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which text and which pattern, of every occurrence."""
        size = np.array([len(t) for t in texts], np.int64)
        codes = self.classify(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"))
        first = np.cumsum(size) - size
        pieces = -(-size // STRETCH)
        text = np.repeat(np.arange(len(texts)), pieces)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        # A stretch is read from where a pattern that ends in it may begin.
        lead = np.minimum(start, max(self.longest - 1, 0))
        at, steps = first[text] + start - lead, lead + np.minimum(STRETCH, size[text] - start)
        order = np.argsort(-steps, kind="stable")  # those that end first are last, so the ones still read are a prefix
        text, at, lead, steps = text[order], at[order], lead[order], steps[order]
        state = np.zeros(len(text), np.int32)
        found_text, found_state = [], []
        live = len(text)
        for k in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps[:live], -k, side="left"))
            state[:live] = self.move[state[:live] * np.int64(self.classes) + codes[at[:live] + k]]
            hit = np.flatnonzero(self.output[state[:live]] & (lead[:live] <= k))
            if len(hit):
                found_text.append(text[hit])
                found_state.append(state[hit])
        if not found_text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, s = np.concatenate(found_text), np.concatenate(found_state)
        out_text, out_pattern = [], []
        while len(s):
            here = self.ends[s] >= 0
            out_text.append(where[here])
            out_pattern.append(self.ends[s[here]].astype(np.int64))
            s = self.link[s]
            where, s = where[s > 0], s[s > 0]
        return np.concatenate(out_text), np.concatenate(out_pattern)


def automata(patterns: list[str], table_bytes: int = TABLE_BYTES) -> list[Automaton]:
    """As many as the patterns' tables need; like patterns lie together, as they share states."""
    out, some, states, chars = [], [], 1, set()
    for p in sorted(set(patterns) - {""}):
        more = chars | set(p)
        if some and (states + len(p)) * (len(more) + 1) * 4 > table_bytes:
            out.append(Automaton(some))
            some, states, more = [], 1, set(p)
        some.append(p)
        states, chars = states + len(p), more
    return out + ([Automaton(some)] if some else [])


def _slices(texts: list[str], chars: int = SLICE) -> Iterator[slice]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _numbered(groups: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each row's group as a number, and a row of each group."""
    seen: dict = {}
    of = np.array([seen.setdefault(tuple(g.values()), len(seen)) for g in groups.to_pylist()], np.int64)
    return of, np.unique(of, return_index=True)[1]


def _tallied(group: np.ndarray, pattern: np.ndarray, text: np.ndarray, patterns: int) -> tuple[np.ndarray, ...]:
    """group, pattern, occurrences, documents from one row per occurrence."""
    by_text = np.unique(text * patterns + pattern, return_counts=True)
    t, p = by_text[0] // patterns, by_text[0] % patterns
    key, back = np.unique(group[t] * patterns + p, return_inverse=True)
    return key // patterns, key % patterns, np.bincount(back, by_text[1], len(key)).astype(np.int64), np.bincount(back, minlength=len(key))


def _group_type(texts: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([T.StructField("__none", T.IntegerType()), *[texts.schema[c] for c in by]])


def _with_groups(texts: DataFrame, text: str, by: list[str]) -> DataFrame:
    return texts.select(F.struct(F.lit(0).cast("int").alias("__none"), *[F.col(f"`{c}`") for c in by]).cast(_group_type(texts, by)).alias("__group"), F.coalesce(F.col(text), F.lit("")).alias("__text"))


def _summed(parts: DataFrame, by: list[str]) -> DataFrame:
    out = parts.groupBy("__group", "pattern").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    return out.select(*[F.col(f"__group.`{c}`").alias(c) for c in by], "pattern", "occurrences", "documents")


def count_by_automaton(texts: DataFrame, text: str, patterns: DataFrame, by: list[str] | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """texts: `text` and the columns `by`; patterns: pattern. Groups by `by`: pattern, occurrences, documents."""
    by = by or []
    rows = patterns.select("pattern").where("pattern <> ''").distinct().limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        return count_by_hash_join(texts, text, patterns, by)
    spark, own = texts.sparkSession, _with_groups(texts, text, by)
    schema = T.StructType([T.StructField("__group", own.schema["__group"].dataType), T.StructField("pattern", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("documents", T.LongType())])

    def counted(a: Automaton) -> DataFrame:
        sent = spark.sparkContext.broadcast(a)  # its table was held to `table_bytes`

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = sent.value
            names = pa.array(a.patterns, pa.string())
            for batch in batches:
                held, every = batch.column("__group"), batch.column("__text").to_pylist()
                of, firsts = _numbered(held)
                for part in _slices(every):
                    where, which = a.find(every[part])
                    if not len(where):
                        continue
                    group, pattern, n, docs = _tallied(of[part], which, where, len(a.patterns))
                    yield pa.RecordBatch.from_arrays([held.take(pa.array(firsts[group])), names.take(pa.array(pattern)), pa.array(n), pa.array(docs)], names=schema.names)

        return own.mapInArrow(run, schema)

    parts = [counted(a) for a in automata([r["pattern"] for r in rows], table_bytes)]
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _summed(out, by)


#: An odd multiplier of the running sums, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def window_hashes(codes: np.ndarray, m: int, up: np.ndarray, down: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """The hash of every window of m codes: sum of code * BASE^(place in the window), modulo 2^64, as the difference of two
    running sums, taken back by the place of the window."""
    if sums is None:
        sums = running(codes, up)
    n = len(codes) - m + 1
    return (sums[m:] - sums[: max(n, 0)]) * down[: max(n, 0)] if n > 0 else np.zeros(0, np.uint64)


def running(codes: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=out[1:])
    return out


def hashed_patterns(patterns: DataFrame) -> DataFrame:
    """pattern -> pattern, m (its length), h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, h = [], []
            for p in batch.column("pattern").to_pylist():
                codes = np.frombuffer(p.encode("utf-32-le"), "<u4")
                m.append(len(codes))
                h.append(int(running(codes, powers(BASE, len(codes)))[-1].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), pa.array(m, pa.int32()), pa.array(h, pa.int64())], names=["pattern", "m", "h"])

    return patterns.select("pattern").where("pattern <> ''").distinct().mapInArrow(run, "pattern string, m int, h long")


def _bitmap(hashed: DataFrame, bits: int) -> np.ndarray:
    """One bit per value of the hashes' lowest `bits` bits: 2^bits / 8 bytes, however many patterns there are."""
    spot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    # Spark's bitmap functions number positions from 1 within buckets of 32,768.
    rows = hashed.select((spot + 1).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("map")).collect()
    out = np.zeros((max(1, (1 << bits) // 32_768), 4_096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["map"], np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").view(bool)


def _distinct_windows(codes: np.ndarray, h: np.ndarray, at: np.ndarray, of: np.ndarray, group: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """group, a place, occurrences and documents of each distinct window of a group; windows of equal hash are compared."""
    order = np.lexsort((of[at], h[at], group))
    at, group = at[order], group[order]
    key = np.diff(h[at].astype(np.int64), prepend=0) != 0
    key |= np.diff(group, prepend=-1) != 0
    key[0] = True
    first = at[np.flatnonzero(key)][np.cumsum(key) - 1]
    same = np.ones(len(at), bool)
    for j in range(m):
        same &= codes[at + j] == codes[first + j]
    if not same.all():  # two windows of one hash: told apart by what they are
        rank: dict = {}
        name = np.array([rank.setdefault((int(g), codes[p : p + m].tobytes()), len(rank)) for g, p in zip(group, at)])
        order = np.lexsort((of[at], name))
        at, group, name = at[order], group[order], name[order]
        key = np.diff(name, prepend=-1) != 0
    new_text = key | (np.diff(of[at], prepend=-1) != 0)
    starts = np.flatnonzero(key)
    return group[starts], at[starts], np.diff(starts, append=len(at)), np.add.reduceat(new_text.astype(np.int64), starts)


def count_by_hash_join(texts: DataFrame, text: str, patterns: DataFrame, by: list[str] | None = None, bits: int = BITMAP_BITS, salts: int = SALTS) -> DataFrame:
    """As `count_by_automaton`, by a join of windows with patterns."""
    by = by or []
    spark, own, hashed = texts.sparkSession, _with_groups(texts, text, by), hashed_patterns(patterns)
    lengths = sorted(r["m"] for r in hashed.select("m").distinct().collect())  # as many as patterns have different lengths
    schema = T.StructType([T.StructField("__group", own.schema["__group"].dataType), *[T.StructField(c, t) for c, t in (("m", T.IntegerType()), ("h", T.LongType()), ("window", T.StringType()), ("occurrences", T.LongType()), ("documents", T.LongType()))]])
    bitmap = spark.sparkContext.broadcast(_bitmap(hashed, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mask = bitmap.value, np.uint64((1 << bits) - 1)
        up, down = powers(BASE, 2 * HASHED), powers(INVERSE, 2 * HASHED)
        for batch in batches:
            every, group, firsts = batch.column("__text").to_pylist(), *_numbered(batch.column("__group"))
            for part in _slices(every, HASHED):
                texts = every[part]
                # Texts are hashed end to end; windows that reach into the next one are left out.
                whole = "".join(texts)
                codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
                if len(codes) > len(up):
                    up, down = powers(BASE, 2 * len(codes)), powers(INVERSE, 2 * len(codes))
                sums, of = running(codes, up), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                for m in lengths:
                    h = window_hashes(codes, m, up, down, sums)
                    at = np.flatnonzero(known[h & mask])
                    at = at[of[at] == of[at + m - 1]] if len(at) else at
                    if len(at):
                        g, where, n, docs = _distinct_windows(codes, h, at, of, group[part.start + of[at]], m)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("__group").take(pa.array(firsts[g])), pa.array(np.full(len(g), m, np.int32)), pa.array(h[where].astype(np.int64)), pa.array([whole[p : p + m] for p in where.tolist()], pa.string()), pa.array(n), pa.array(docs)],
                            names=schema.names,
                        )

    windows = own.mapInArrow(run, schema)
    windows = windows.groupBy("__group", "m", "h", "window").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
    # Common windows are as many rows as there are groups of texts: they are dealt to `salts` tasks, and so are the patterns.
    windows = windows.withColumn("salt", F.pmod(F.xxhash64("__group"), F.lit(salts)).cast("int"))
    dealt = hashed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = windows.join(dealt, ["m", "h", "salt"]).where(F.col("window") == F.col("pattern"))
    return _summed(found, by)
