"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule: knots (t, w) over training time 0..1, linear between them. Its integral
is the source's weight; shares of all words follow the weights, a source never gives more than `max_epochs`
times its own words, and what it can't give is shared anew by weight (water filling, solved in closed form by
one window over the table of sources). The source's words, in a fixed pseudo-random order of its documents
and repeated by epoch, are then laid along training time: cumulative demand is the schedule's running integral
times the target, and its inverse gives each take its time. The demand of all sources together up to that time, as a
share of the whole, is its training position: half of all words lie before 0.5. Takes are range-sorted by position.

Everything is DataFrame expressions. The running sum inside a source is made in two levels (`running_sum`),
so a source with a third of all rows is dealt over as many tasks as its rows need.

Defined cases: null text has size 0; a text of any length is counted whole; null doc_ids are told apart by their texts; a null source is a source of its own, ranked last; sources without words
get target 0; rows that are equal in every column are interchangeable; an empty table gives an empty result;
further columns of any name are kept out of the way in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, pack_row, running_sum, small, table, unpack_row, word_count

Knots = list[tuple[float, float]]
#: Weights of the sources in code-point order, repeating, and the course of each weight (integral 1).
WEIGHTS = (5.0, 2.0, 1.0)
COURSES: tuple[Knots, ...] = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)])
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 1_000


def area(knots: Knots) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def time_of(share: Column, knots: Knots) -> Column:
    """The time at which the schedule's running integral reaches `share` (0..1) of its whole."""
    total, done, out = area(knots), 0.0, None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        rest = F.greatest(share * F.lit(total) - F.lit(done), F.lit(0.0))
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest)
        at = F.lit(t0) + F.least(F.lit(2.0) * rest / (F.lit(w0) + root), F.lit(t1 - t0))
        done += (t1 - t0) * (w0 + w1) / 2
        out = at if out is None else F.when(share * F.lit(total) <= F.lit(done - (t1 - t0) * (w0 + w1) / 2), out).otherwise(at)
    return out


def reached(t: Column, knots: Knots) -> Column:
    """The share of the schedule's whole integral that lies before time t."""
    out = F.lit(0.0)
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        x = F.least(F.greatest(t - F.lit(t0), F.lit(0.0)), F.lit(t1 - t0))
        out = out + F.lit(w0) * x + F.lit((w1 - w0) / (t1 - t0) / 2) * x * x
    return out / F.lit(area(knots))


def source_targets(sizes: DataFrame, weights=WEIGHTS, courses=COURSES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, __size, __source_size -> one row per source: __idx, source, __n, __source_size, __target.

    One row per source meets in the window, never a source's documents.
    """
    per = sizes.groupBy("source").agg(F.sum("__size").alias("__source_size"), F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__idx", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    full = [w * area(c) for w, c in zip(weights, courses)]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in full]), F.col("__idx") % len(full) + 1)
    cap = (F.lit(max_epochs) * F.col("__source_size")).cast("double")
    per = per.withColumn("__w", weight).withColumn("__cap", cap)
    per = per.withColumn("__total", F.sum("__source_size").over(W.partitionBy()))
    order = W.orderBy(F.col("__cap") / F.col("__w"), "__idx")
    spent = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("__level", (F.col("__total") - spent) / left)
    per = per.withColumn("__level", F.max("__level").over(W.partitionBy()))
    return per.select("__idx", "source", "__n", "__source_size", F.least("__cap", F.col("__level") * F.col("__w")).alias("__target"))


def assign(sized: DataFrame, weights=WEIGHTS, courses=COURSES, max_epochs: int = MAX_EPOCHS, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Give each row its takes.

    `sized`: source, __size (long), __key (string that orders a source's rows pseudo-randomly; rows with equal __key
    and __size are interchangeable), plus any further columns.
    Adds __source_size, __target, __taken (words taken, repeats counted), __takes (array of epoch, words,
    position) and __position (of the first take, null without one).
    """
    targets = materialize(source_targets(sized, weights, courses, max_epochs), "mix-sources")
    n = targets.count()
    # The demand of each course's sources together: as many numbers as there are courses.
    by_course = {r["k"]: r["d"] for r in targets.groupBy((F.col("__idx") % len(courses)).alias("k")).agg(F.sum("__target").alias("d")).collect()}
    every = sum(by_course.get(k, 0.0) for k in range(len(courses))) or 1.0
    marked = sized.withColumn("__src", F.coalesce(F.col("source"), F.lit(""))).withColumn("__nosrc", F.col("source").isNull())
    named = targets.select(
        "__idx", F.col("__n").alias("__rows"), "__source_size", "__target", F.coalesce(F.col("source"), F.lit("")).alias("__src"), F.col("source").isNull().alias("__nosrc")
    )
    marked = marked.join(small(named, n), ["__src", "__nosrc"]).drop("__src", "__nosrc")
    # A source has as many buckets as its rows need.
    slices = F.ceil(F.col("__rows") / F.lit(rows_per_bucket))
    bucket = F.floor(F.conv(F.substring(F.md5("__key"), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * slices).cast("long")
    marked = marked.withColumn("__hash", F.md5("__key")).withColumn("__bucket", bucket)
    summed = running_sum(marked, ["__idx"], ["__hash", "__key", "__size"], "__size", "__bucket", "__before")
    demand = F.floor("__target").cast("long")
    epochs = F.when(F.col("__source_size") > 0, F.floor(demand / F.col("__source_size"))).otherwise(0).cast("long")
    summed = summed.withColumn("__demand", demand).withColumn("__full", epochs)
    rest = F.col("__demand") - F.col("__full") * F.col("__source_size")
    part = F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col("__size"))
    summed = summed.withColumn("__part", part)

    def take(e: int) -> Column:
        words = F.when(F.col("__full") > e, F.col("__size")).when(F.col("__full") == e, F.col("__part")).otherwise(0).cast("long")
        share = (F.lit(e) * F.col("__source_size") + F.col("__before") + words / 2) / F.nullif(F.col("__demand"), F.lit(0))
        spot = F.lit(None).cast("double")
        for k, knots in enumerate(courses):
            spot = F.when(F.col("__idx") % len(courses) == k, time_of(share, knots)).otherwise(spot)
        return F.struct(F.lit(e).alias("epoch"), words.alias("words"), spot.alias("time"))

    def place(x: Column) -> Column:
        before = [F.lit(by_course.get(k, 0.0)) * reached(x["time"], knots) for k, knots in enumerate(courses)]
        total = before[0]
        for b in before[1:]:
            total = total + b
        return F.struct(x["epoch"].alias("epoch"), x["words"].alias("words"), (total / F.lit(every)).alias("position"))

    takes = F.transform(F.filter(F.array(*[take(e) for e in range(max_epochs)]), lambda x: x["words"] > 0), place)
    summed = summed.withColumn("__takes", takes)
    summed = summed.withColumn("__taken", F.aggregate("__takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    summed = summed.withColumn("__position", F.get(F.col("__takes"), F.lit(0))["position"])
    return summed.drop("__hash", "__bucket", "__before", "__demand", "__full", "__part", "__idx", "__rows")


def order_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("none:"), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed training set: the columns of `docs`, one row per take, range-sorted by training position.

    A take that the target ends inside a document keeps the document's first words, with their white space.
    """
    own, kept = docs.columns, ["doc_id", "text", "source", *(["n_chars"] if "n_chars" in docs.columns else [])]
    sized = pack_row(docs, *kept).withColumn("__size", word_count(F.col("text"))).withColumn("__key", order_key(F.col("doc_id"), F.col("text")))
    takes = assign(sized, **options).withColumn("__take", F.explode("__takes"))
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("__take.words") >= F.col("__size"), F.col("text")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.col("__take.words").cast("int")), "")
    )
    takes = takes.withColumn("__position", F.col("__take.position")).withColumn("text", text)
    if "n_chars" in own:
        takes = takes.withColumn("n_chars", F.length("text").cast("long"))
    return unpack_row(takes.orderBy("__position", "__key"), own, *kept)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("__size"), order_key(F.col("doc_id"), F.col("text")).alias("__key"))
    rows = assign(materialize(sized, "mix-sizes"))
    return rows.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
        F.col("__position").alias("position"),
    ).orderBy("position", "doc_id").withColumn("position", F.round("position", 6))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'none:' || md5(coalesce(text, ''))) AS k
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx
  FROM d GROUP BY source
), capped AS (
  SELECT *, [5.0, 2.0, 1.0][(idx % 3 + 1)::INT]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap,
         sum(source_size) OVER () AS total
  FROM per
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), targets AS (
  SELECT *, least(cap, max(level) OVER () * w) AS target FROM levels
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.idx, floor(t.target)::BIGINT AS demand,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS full_epochs,
         coalesce(sum(d.size) OVER (PARTITION BY t.idx ORDER BY md5(d.k), d.k, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), y AS (
  SELECT *, least(greatest(demand - full_epochs * source_size - before, 0), size) AS part FROM x
), z AS (
  SELECT *, full_epochs * size + part AS taken,
         CASE WHEN full_epochs > 0 THEN size ELSE part END AS first_words FROM y
), s AS (
  SELECT *, (before + first_words / 2) / demand::DOUBLE AS share FROM z
), spots AS (
  SELECT *, CASE WHEN first_words = 0 THEN NULL
            WHEN idx % 3 = 0 THEN least(2 * share / (1.5 + sqrt(2.25 - 2 * share)), 1.0)
            WHEN idx % 3 = 1 THEN share
            WHEN share <= 0.375 THEN 2 * share / (0.5 + sqrt(0.25 + 2 * share))
            ELSE 0.5 + least(2 * (share - 0.375) / (1.0 + sqrt(1.0 + 2 * (share - 0.375))), 0.5) END AS t
  FROM s
), demands AS (
  SELECT sum(target) FILTER (idx % 3 = 0) AS a, coalesce(sum(target) FILTER (idx % 3 = 1), 0) AS b, coalesce(sum(target) FILTER (idx % 3 = 2), 0) AS c FROM targets
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       round((a * (1.5 * t - 0.5 * t * t) + b * t + c * (0.5 * t + 0.5 * t * t)) / (a + b + c), 6) AS position
FROM spots, demands
"""

QUERIES = {"op1_mixing": op1_mixing}
SQL = {"op1_mixing": OP1_SQL}
