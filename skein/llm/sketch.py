"""Document fingerprints: bottom-k sketches of five-word shingles.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles (signed order). It is
whole if it holds fewer than k. Sketches merge across parts, and estimate resemblance, containment and the number
of distinct shingles. All of it is column expressions; the plan has no Python.

`neighbours` gives each row the next row by doc_id without a global window: rows are dealt into ranges of doc_id
(quantile bounds, subdivided evenly, as many as the bytes need), and the first row of each range is copied to the
end of the range before it, the very first to the last. So a window over one range sees every successor.

Defined cases: null text is empty; a text of fewer than five words is one shingle; one without words has an empty
sketch, and two empty sketches are alike (1.0), an empty and another are not (0.0); a null doc_id sorts first;
rows of equal doc_id follow one another in the order of their text's hash, and rows repeated whole in any order, as they
are alike; a text of any length is read whole, in memory in proportion to its words; an empty table gives an empty
result; further columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_slices, materialize, small, table, words
from .xxh64_sql import xxh64

K = 128
SHINGLE = 5
CHARS_PER_RANGE = 4_000_000
QUANTILES = 256
_NO_HASHES = "array<bigint>"


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    w = words(text)

    def of(w: Column) -> Column:
        size = F.size(w)
        each = F.transform(F.sequence(F.lit(0), size - F.lit(n)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + F.lit(j)) for j in range(n)])))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(size == 0, F.array().cast(_NO_HASHES)).when(size < n, one).otherwise(each)

    # A one-element transform binds the words to a variable: they are split once.
    hashes = F.get(F.transform(F.array(w), of), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; each task keeps k hashes of a key at most before the shuffle."""
    hashes = parts.select(*key, F.explode(column).alias("__h"))
    # Equal hashes have equal ranks, so k ranks are k distinct hashes; ranks are cut in each task before the shuffle.
    kept = hashes.withColumn("__n", F.dense_rank().over(W.partitionBy(*key).orderBy("__h"))).where(F.col("__n") <= k)
    return kept.groupBy(*key).agg(F.sort_array(F.collect_set("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the share of both among the k smallest of the union."""
    both = F.array_intersect(a, b)
    union = merge(a, b, k)
    share = F.size(F.array_intersect(union, both)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = resemblance(a, b, k)
    common = j / (F.lit(1.0) + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def ranges(docs: DataFrame, chars_per_range: int) -> tuple[Column, int]:
    """An expression that numbers a row's range of __id, increasing in it, and how many ranges there may be."""
    n = in_slices(docs.agg(F.coalesce(F.sum(F.length("__text")), F.lit(0))).first()[0], chars_per_range)
    tops = min(n, QUANTILES)
    each = in_slices(n, tops)
    cuts = docs.agg(F.percentile_approx("__id", [i / tops for i in range(tops + 1)], 10_000)).first()[0] or [0]
    bounds = sorted(set(cuts))
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    top = F.greatest(F.size(F.filter(array, lambda b: b <= F.col("__id"))), F.lit(1))
    lo = F.element_at(array, top).cast("double")
    hi = F.coalesce(F.try_element_at(array, top + 1).cast("double"), lo + 1)
    part = F.least(F.greatest(F.floor((F.col("__id").cast("double") - lo) / (hi - lo) * each), F.lit(0)), F.lit(each - 1))
    return (top.cast("long") * F.lit(each) + part).cast("long"), len(bounds) * each


def with_next(docs: DataFrame, chars_per_range: int = CHARS_PER_RANGE) -> tuple[DataFrame, W]:
    """Rows of `docs` (__id, __text and more) with __range, __copy and the window that orders them by doc_id.

    Rows with __copy are the first of the next range, to be dropped once the window has been used.
    """
    number, _ = ranges(docs, chars_per_range)
    placed = docs.withColumn("__range", number)
    firsts = placed.groupBy("__range").agg(F.min("__id").alias("__first"))
    order = W.orderBy("__range")
    before = F.coalesce(F.lag("__range").over(order), F.max("__range").over(W.partitionBy()))
    firsts = materialize(firsts.withColumn("__before", before), "sketch-ranges")
    placed = placed.join(small(firsts, firsts.count()), "__range")
    here = F.struct(F.col("__range").alias("r"), F.lit(False).alias("copy"))
    there = F.struct(F.col("__before").alias("r"), F.lit(True).alias("copy"))
    placed = placed.withColumn("__to", F.explode(F.when(F.col("__id") == F.col("__first"), F.array(here, there)).otherwise(F.array(here))))
    placed = placed.withColumn("__range", F.col("__to.r")).withColumn("__copy", F.col("__to.copy")).drop("__to", "__first", "__before")
    return placed, W.partitionBy("__range").orderBy("__copy", "__id", "__hash")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    rows, order = with_next(own)
    rows = rows.withColumn("__edited", edited(F.col("__text"), F.lead("__text").over(order)))
    rows = rows.select("doc_id", "__id", "__hash", "__range", "__copy", F.length("__text").cast("long").alias("n_chars"), "__edited", sketch(F.col("__text")).alias("__own"))
    rows = rows.withColumn("__next", F.lead("__own").over(order)).where(~F.col("__copy"))
    rows = rows.withColumn("__other", sketch(F.col("__edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__own")).alias("fingerprint"),
        as_text(F.col("__other")).alias("edited_fingerprint"),
        resemblance(F.col("__own"), F.col("__other")).alias("near_edited"),
        resemblance(F.col("__own"), F.col("__next")).alias("near_next"),
        distinct_shingles(F.col("__own")).alias("shingles"),
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST), first_value(t) OVER (ORDER BY doc_id NULLS FIRST)) AS following FROM d
), x AS (
  SELECT doc_id, t, n, following, substr(t, 1, n - n // 2) || substr(following, 1, n // 2) AS edited FROM e
), texts AS (
  SELECT t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w FROM (SELECT t FROM x UNION SELECT edited FROM x)
), sh AS (
  SELECT t, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS s
  FROM texts
), {xxh64("sh", "hs")}, signed AS (
  SELECT s, (CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS v FROM hs
), sketches AS (
  SELECT t, list(DISTINCT v) AS every FROM sh JOIN signed USING (s) GROUP BY t
), k AS (
  SELECT t, coalesce(list_sort(every)[1:{K}], []) AS v FROM texts LEFT JOIN sketches USING (t)
), named AS (
  SELECT t, v, array_to_string(list_transform(v, lambda y: lower(lpad(hex(y), 16, '0'))), '') AS c FROM k
), j AS (
  SELECT doc_id, n, edited, a.v AS va, a.c AS ca, b.v AS vb, b.c AS cb, f.v AS vf
  FROM x JOIN named a ON a.t = x.t JOIN named b ON b.t = x.edited JOIN k f ON f.t = x.following
), u AS (
  SELECT *, list_sort(list_distinct(list_concat(va, vb)))[1:{K}] AS ub, list_sort(list_distinct(list_concat(va, vf)))[1:{K}] AS uf FROM j
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, ca AS fingerprint, cb AS edited_fingerprint,
       CASE WHEN len(ub) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(ub, list_intersect(va, vb)))::DOUBLE / len(ub) END AS near_edited,
       CASE WHEN len(uf) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(uf, list_intersect(va, vf)))::DOUBLE / len(uf) END AS near_next,
       CASE WHEN len(va) < {K} THEN len(va)::DOUBLE ELSE {float(K - 1)}::DOUBLE / ((va[-1]::DOUBLE + 9223372036854775808.0::DOUBLE) / 18446744073709551616.0::DOUBLE) END AS shingles
FROM u
"""

QUERIES = {"op4_sketch": op4_sketch}
SQL = {"op4_sketch": OP4_SQL}
