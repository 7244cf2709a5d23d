"""Target-distribution importance resampling over hashed n-grams, by an external sort-count.

Documents are drawn so that their n-gram buckets look like a target corpus's. Three passes, each with a bounded state:

1. `streams` writes, per slice of documents, one packed stream of little-endian uint16 bucket numbers and the offset at
   which each document's part ends. Texts are read once; nothing after this pass reads them again.
2. `counts` sorts each stream, run-length encodes it, and adds the runs up by bucket: one row per bucket at most.
3. `gather` looks every stream's buckets up in the table of gains and sums each document's part with np.add.reduceat.

A bucket's gain is floor(1000 ln) of its smoothed share in the target over its share in the documents; a document's
weight is the floored mean of its gains, and its score adds a Gumbel variate made from its id, so that the highest
scores are a draw without replacement in proportion to exp(weight / 1000). Ranks are made in two levels: documents per
score (whole numbers, of which there are as many as gains and variates allow, whatever the number of documents), then
row numbers among those of one score that may be drawn. No window holds all documents.

The table of gains has `buckets` rows (65,536 at most, as a bucket fits in uint16), which bounds what is collected and
sent to tasks.

Defined cases: null and empty texts have no features and weight 0; a text of any length is read in pieces of
`PIECE` bytes, so only its stream, two bytes a feature, is held; a null doc_id hashes as the empty string and comes after all others among ties;
rows repeated whole are drawn each, and equal ids of equal scores are numbered in any order; an empty target gives gains by
the documents alone; empty tables give empty results; further columns keep their names and values, whatever they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small, small_batches, table
from .sharding import CRC32, CRC32_TABLE

BUCKETS, MAX_N = 10_000, 2
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Features of a slice, and bytes of a text that are cut into words at once.
SLICE, PIECE = 1 << 20, 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, piece by piece; pieces end between words."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield _WORD.findall(data[at:end].lower())
        at = end


def document_buckets(data: bytes, buckets: int = BUCKETS, max_n: int = MAX_N, size: int = PIECE) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to max_n words, in no particular order, and the number of words.

    The CRC-32 of a run goes on from that of the run that is one word shorter.
    """
    parts, n_words, tail = [], 0, []
    for words in pieces(data, size):
        n_words += len(words)
        old, words = len(tail), tail + words
        crcs, spaced = list(map(zlib.crc32, words)), [b" " + w for w in words]
        for k in range(1, max_n + 1):
            # Runs that end in the words carried over were counted with the piece before.
            fresh = crcs[max(0, old - k + 1) :]
            parts.append((np.fromiter(fresh, np.uint32, len(fresh)) % np.uint32(buckets)).astype("<u2"))
            crcs = list(map(zlib.crc32, islice(spaced, k, None), crcs))
        tail = words[max(0, len(words) - max_n + 1) :] if max_n > 1 else []
    return (np.concatenate(parts) if parts else np.zeros(0, "<u2")), n_words


def streams(docs: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, slice_features: int = SLICE) -> DataFrame:
    """stream (packed uint16), ends (where each document's part ends), words, rows (all other columns): a row per slice.

    Written to the shared folder.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit in two bytes")
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in others]).alias("__row"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("__text"))
    row_type = own.schema["__row"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, texts, first = batch.column("__row"), batch.column("__text"), 0
            parts, words, size = [], [], 0
            for i in range(batch.num_rows):
                found, n = document_buckets(texts[i].as_py(), buckets, max_n)
                parts.append(found)
                words.append(n)
                size += len(found)
                if size < slice_features and i + 1 < batch.num_rows:
                    continue
                ends = np.cumsum([len(p) for p in parts])
                rows = pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), held.slice(first, len(parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.concatenate(parts).tobytes()], pa.binary()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), rows],
                    names=["stream", "ends", "words", "rows"],
                )
                parts, words, size, first = [], [], 0, i + 1

    schema = T.StructType([T.StructField("stream", T.BinaryType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(row_type))])
    return materialize(small_batches(own).mapInArrow(write, schema), "importance-streams")


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted stream's distinct values and the lengths of their runs."""
    starts = np.flatnonzero(np.diff(stream, prepend=stream[:1] ^ 1)) if len(stream) else np.zeros(0, np.int64)
    return stream[starts], np.diff(starts, append=len(stream))


def counts(written: DataFrame) -> DataFrame:
    """bucket, n: how often each bucket occurs in all streams."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("stream"):
                value, n = runs(np.sort(np.frombuffer(s.as_buffer(), "<u2"), kind="stable"))
                yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    return written.select("stream").mapInArrow(encode, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's floored 1000 ln of its share in the target over that in the documents, one count added to each."""
    every, wanted = sum(own.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (every + buckets) / ((own.get(b, 0) + 1) * (wanted + buckets)))) for b in range(buckets)]


def document_weights(stream: np.ndarray, ends: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The floored mean of each document's gains; 0 without any."""
    size = np.diff(ends, prepend=0)
    out, some = np.zeros(len(ends), np.int64), size > 0
    if some.any():
        # Documents without a feature have no part, so each remaining part ends where the next one starts.
        out[some] = np.add.reduceat(gain[stream], (ends - size)[some]) // size[some]
    return out


def gather(written: DataFrame, gain: list[int]) -> DataFrame:
    """rows' columns as __row, with n_features, n_words and weight."""
    gain = np.array(gain, np.int64)
    row_type = written.schema["rows"].dataType.elementType

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                stream = np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")
                ends, rows = (batch.column(c).slice(i, 1).flatten() for c in ("ends", "rows"))
                ends = ends.to_numpy(zero_copy_only=False)
                size, weight = np.diff(ends, prepend=0), document_weights(stream, ends, gain)
                yield pa.RecordBatch.from_arrays([rows, pa.array(size), batch.column("words").slice(i, 1).flatten(), pa.array(weight)], names=["__row", "__n", "__words", "__weight"])

    schema = T.StructType([T.StructField("__row", row_type), *[T.StructField(c, T.LongType()) for c in ("__n", "__words", "__weight")]])
    return small_batches(written).mapInArrow(look_up, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds __rank to a written table of __id, __words, __score: 1, 2, 3 ... of those drawn, else null."""
    per = scored.where(F.col("__words") >= min_words).groupBy("__score").agg(F.count(F.lit(1)).alias("__here"))
    order = W.orderBy(F.desc("__score"))  # one row per score
    per = materialize(per.withColumn("__before", F.coalesce(F.sum("__here").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "importance-scores")
    total, scores = per.agg(F.coalesce(F.sum("__here"), F.lit(0)), F.count(F.lit(1))).first()
    draw = percent * total // 100
    open_scores = per.where(F.col("__before") < draw).select("__score", "__before")
    marked = scored.join(small(open_scores, scores), "__score", "left").withColumn("__open", F.col("__before").isNotNull() & (F.col("__words") >= min_words))
    number = F.col("__before") + F.row_number().over(W.partitionBy("__score").orderBy(F.col("__id").asc_nulls_last()))
    drawn = marked.where("__open").withColumn("__rank", number.cast("long"))
    drawn = drawn.withColumn("__rank", F.when(F.col("__rank") <= draw, F.col("__rank")))
    rest = marked.where(~F.col("__open")).withColumn("__rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("__open", "__before")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text and more; target: text. The columns of docs but the text as __row, with __id, __n, __words, __weight, __score, __rank."""
    own, wanted = streams(docs, buckets, max_n), streams(target.select("text"), buckets, max_n)
    own_counts, wanted_counts = ({r["bucket"]: r["n"] for r in counts(s).collect()} for s in (own, wanted))  # `buckets` rows at most
    scored = gather(own, gains(own_counts, wanted_counts, buckets)).withColumn("__id", F.col("__row.doc_id"))
    scored = materialize(scored.withColumn("__score", F.col("__weight") + gumbel(F.col("__id"), seed)), "importance-scored")
    return ranked(scored, percent, min_words)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_features"), F.col("__weight").alias("weight"), F.col("__score").alias("score"), F.col("__rank").alias("rank"))


_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH bytewise AS ({CRC32_TABLE}),
own AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
wanted AS (SELECT regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark),
own_runs AS (
  SELECT r, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM own
), wanted_runs AS (
  SELECT unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM wanted
), every AS (
  SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda v: ('0x' || v)::BIGINT) AS l FROM (SELECT f FROM own_runs UNION SELECT f FROM wanted_runs)
), b AS (
  SELECT f, {CRC32.format(b="l")} % {BUCKETS} AS bucket FROM every, bytewise
), s AS (SELECT bucket, count(*) AS n FROM own_runs JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted_runs JOIN b USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::BIGINT AS every, (SELECT coalesce(sum(n), 0) FROM t)::BIGINT AS wanted),
g AS (
  SELECT x.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (every + {BUCKETS}))::DOUBLE / ((coalesce(s.n, 0) + 1) * (wanted + {BUCKETS}))::DOUBLE))::BIGINT AS gain
  FROM range({BUCKETS}) AS x(bucket) CROSS JOIN totals LEFT JOIN s ON s.bucket = x.bucket LEFT JOIN t ON t.bucket = x.bucket
), sums AS (
  SELECT r, count(*) AS n, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM own_runs JOIN b USING (f) JOIN g USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM own LEFT JOIN sums USING (r)
), places AS (
  SELECT *, CASE WHEN words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) END AS place,
         count(*) FILTER (words >= {MIN_WORDS}) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM places
"""

QUERIES = {"op11_importance": op11_importance}
SQL = {"op11_importance": OP11_SQL}
