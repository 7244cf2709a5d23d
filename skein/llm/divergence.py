"""How far the sources of a language differ, term by term, by a systolic rotation of compressed term vectors.

A group is the documents of one (lang, source). Over the terms that a language keeps (those in `MIN_DOCS` of its documents
at least), a group's vector has p = 1 + floor(10^9 (count + 1) / (N + V)) for each term, and f(p, q) = floor((p - q)^2 / q)
is what a term adds to a group's divergence from one with q. All of it is whole numbers.

1. `count_terms` counts terms per group, and documents per term, inside each task before anything is shuffled, so a
   source with a third of all rows gives as many rows as any other task's share.
2. `pack_blocks` deals a language's kept terms to blocks of about `BLOCK_ENTRIES` entries by a hash of the term, and writes
   each group's part of a block as one compressed vector (places by differences, values as uint32). There the language's
   own vector is met too: a heap per group and block holds the `top` terms that stand out most; heaps are merged in a window.
3. `rotate` lets every group's vector meet every other's of its language once per block. Groups sit in a ring and stay in
   the partition of their seat; in round r each seat's vector comes by at the seat r places before it, so each pair meets
   at one seat only and both directions are evaluated in that meeting. Travelling vectors stream past in the order of
   rounds, one at a time. A job takes `ROUNDS_A_JOB` rounds, so shuffles hold that many copies of the vectors at most,
   however many sources there are. Terms that neither of two vectors has are not looked at: both have the value of a
   count of 0 there, so they are added by their number.

A term's rows lie in one block, and a block has about as many entries as asked for, so a vector in a task is bounded;
with more sources than that, by the sources that have one term.

Defined cases: null text, lang and source are ''; texts of any length are read in pieces; a group without terms is a group
with counts of 0; a language that keeps no term gives pairs of value 0 and no terms; rows repeated whole count each; ties of a
value go by the item's bytes; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small, small_batches, table

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Entries (a term of a group) of a block, of all groups together.
BLOCK_ENTRIES = 200_000
ROUNDS_A_JOB = 16
#: Terms that a task counts before it hands them on, and bytes of a text cut at once.
COUNTED, PIECE = 400_000, 1 << 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def term_pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if at + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield _TERM.findall(data[at:end].lower())
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: written. A group's row with a null term says that the group occurs."""
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))

    def rows(counts: dict, seen: dict) -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), c in counts.items():
            d = seen[lang, source]
            langs += [lang] * (len(c) + 1)
            sources += [source] * (len(c) + 1)
            terms += [*c, None]
            n += [*c.values(), 0]
            docs += [*map(d.__getitem__, c), 0]
        arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        seen: dict = {}
        for batch in batches:
            texts = batch.column("text")
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                c, d, here = counts.setdefault(group, Counter()), seen.setdefault(group, Counter()), set()
                for words in term_pieces(texts[i].as_py()):
                    c.update(words)
                    here.update(words)
                d.update(here)
            if sum(map(len, counts.values())) > COUNTED:
                yield rows(counts, seen)
                counts, seen = {}, {}
        if counts:
            yield rows(counts, seen)

    parts = small_batches(own).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return materialize(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def part_of(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (N + V)), exact whatever the counts: in decimals of 38 digits."""
    whole = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    return (F.lit(1) + F.floor(F.call_function("div", whole, (n + v).cast("decimal(20,0)")))).cast("long")


def kept_terms(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, all (its count in the language): the terms that a language keeps."""
    per = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    return per.where(F.col("docs") >= min_docs).drop("docs")


def ring(counted: DataFrame, kept: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, seat (from 0, by source), size (of the ring), n, v, p0 and the language's all, blocks; a row per group."""
    found = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("entries"))
    groups = counted.where("term is null").select("lang", "source").distinct().join(found, ["lang", "source"], "left").na.fill(0, ["n", "entries"])
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    every = W.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "n", (F.row_number().over(every.orderBy("source")) - 1).alias("seat"), F.count(F.lit(1)).over(every).alias("size"),
        F.sum("n").over(every).alias("lang_n"), F.greatest(F.ceil(F.sum("entries").over(every) / F.lit(BLOCK_ENTRIES)), F.lit(1)).cast("int").alias("blocks"),
    )
    groups = groups.join(of_lang, "lang", "left").na.fill(0, ["v"])
    none = F.lit(0).cast("long")
    p0 = F.when(F.col("v") == 0, F.lit(1).cast("long")).otherwise(part_of(none, F.col("n"), F.col("v")))
    return groups.withColumn("p0", p0)


def squeeze(at: np.ndarray, p: np.ndarray) -> bytes:
    """A vector's sorted places and its values, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + p.astype("<u4").tobytes(), 1)


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); values of at most 10^9 + 1 keep the square under 2^63."""
    d = p - q
    return d * d // q


def local_top(terms: list, value: np.ndarray, top: int) -> list[tuple[int, bytes]]:
    """The `top` largest values, ties to the lesser term."""
    if len(value) > top:
        least = np.partition(value, len(value) - top)[len(value) - top]
        chosen = np.flatnonzero(value >= least)
    else:
        chosen = np.arange(len(value))
    return heapq.nsmallest(top, ((-int(value[i]), terms[i].as_py().encode()) for i in chosen))


def pack_blocks(entries: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, block, vector (null in rows of terms), term, value: written."""
    g = groups.select("lang", "source", "n", "v", "lang_n", "blocks").withColumnRenamed("n", "group_n")
    own = entries.join(small(g, groups.count()), ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    own = own.select("lang", "source", block.alias("block"), "term", part_of(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), part_of(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))

    def pack(t: pa.Table) -> pa.Table:
        lang, block = t["lang"][0].as_py(), t["block"][0].as_py()
        sources, terms = t["source"].combine_chunks().dictionary_encode(), t["term"].combine_chunks()
        # Places number the block's terms; any order that all groups share will do, and a dictionary gives one.
        code = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        p, q = t["p"].to_numpy(), t["q"].to_numpy()
        group = sources.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((code, group))
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        out: list[tuple] = []
        for rows in np.split(order, cuts):
            source = sources.dictionary[int(group[rows[0]])].as_py()
            out.append((source, squeeze(code[rows], p[rows]), None, None))
            over = rows[p[rows] > q[rows]]
            out += [(source, None, term.decode(), -v) for v, term in local_top([terms[int(i)] for i in over], apart(p[over], q[over]), top)]
        columns = list(zip(*out))
        arrays = [pa.array([lang] * len(out), pa.string()), pa.array(columns[0], pa.string()), pa.array([block] * len(out), pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())]
        return pa.Table.from_arrays(arrays, names=["lang", "source", "block", "vector", "term", "value"])

    return materialize(own.groupBy("lang", "block").applyInArrow(pack, "lang string, source string, block int, vector binary, term string, value long"), "divergence-blocks")


def meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a0: int, b0: int) -> tuple[int, int, int]:
    """Sums of both directions over the terms that either vector has, and the number of these terms."""
    at = np.union1d(a[0], b[0])
    p, q = np.full(len(at), a0, np.int64), np.full(len(at), b0, np.int64)
    p[np.searchsorted(at, a[0])] = a[1]
    q[np.searchsorted(at, b[0])] = b[1]
    return int(apart(p, q).sum()), int(apart(q, p).sum()), len(at)


def rotate(vectors: DataFrame, groups: DataFrame, rounds_a_job: int = ROUNDS_A_JOB) -> DataFrame:
    """lang, source, item, value, terms: a row per meeting and direction; the groups of a language meet in a tournament."""
    spark = vectors.sparkSession
    seats = groups.select("lang", "source", "seat", "size", "p0", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    seated = materialize(seats.join(vectors, ["lang", "source", "block"], "left"), "divergence-seated")
    last = groups.agg(F.max(F.floor(F.col("size") / 2)).cast("int")).first()[0] or 0

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                vector = none if r["vector"] is None else unsqueeze(r["vector"])
                if r["round"] == 0:  # the resident of this seat; its visitors follow
                    own = (r, vector)
                    continue
                here = own[0]
                forth, back, terms = meet(own[1], vector, here["p0"], r["p0"])
                out += [(r["lang"], here["source"], r["source"], forth, terms), (r["lang"], r["source"], here["source"], back, terms)]
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "item", "value", "terms"])
                out = []

    met = []
    for first in range(1, last + 1, rounds_a_job):
        r = F.col("round")
        travel = seated.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(min(first + rounds_a_job - 1, last)))))
        to = F.pmod(F.col("seat") - r, F.col("size"))
        # In a ring of even size the last round would bring every pair together twice: half of the seats receive.
        travel = travel.where((2 * r < F.col("size")) | ((2 * r == F.col("size")) & (to < r))).withColumn("to", to)
        both = seated.withColumn("round", F.lit(0)).withColumn("to", F.col("seat")).unionByName(travel)
        dealt = both.repartition("lang", "block", "to").sortWithinPartitions("lang", "block", "to", "round").select("lang", "source", "round", "p0", "vector")
        met.append(materialize(small_batches(dealt).mapInArrow(stream, "lang string, source string, item string, value long, terms long"), "divergence-met"))
    if not met:
        return spark.createDataFrame([], "lang string, source string, item string, value long, terms long")
    out = met[0]
    for m in met[1:]:
        out = out.unionByName(m)
    return out


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, rounds_a_job: int = ROUNDS_A_JOB) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counted = count_terms(docs.select("lang", "source", "text"))
    kept = materialize(kept_terms(counted, min_docs), "divergence-kept")
    entries = materialize(counted.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-entries")
    groups = materialize(ring(counted, kept, entries), "divergence-groups")
    packed = pack_blocks(entries, groups, top)
    met = rotate(packed.where("term is null").select("lang", "source", "block", "vector"), groups, rounds_a_job)
    sums = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    n = groups.count()
    own = small(groups.select("lang", "source", "v", F.col("p0").alias("p")), n)
    other = small(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q")), n)
    p, q = F.col("p"), F.col("q")
    rest = (F.col("v") - F.col("terms")) * F.call_function("div", (p - q) * (p - q), q)
    pairs = sums.join(own, ["lang", "source"]).join(other, ["lang", "item"]).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + rest).alias("value"))
    terms = packed.where("term is not null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_P = f"(1 + {SCALE}::HUGEINT * ({{n}} + 1) // ({{all}} + v))"
OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_LETTERS}') AS w
  FROM documents
), x AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS c FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS lang_n FROM kept GROUP BY lang
), counts AS (
  SELECT x.lang, source, x.term, count(*)::HUGEINT AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), vectors AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", all="group_n")} AS p, {_P.format(n="k.c", all="lang_n")} AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM vectors a JOIN vectors b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM vectors WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP}
"""

QUERIES = {"op13_divergence": op13_divergence}
SQL = {"op13_divergence": OP13_SQL}
