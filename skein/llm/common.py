"""Helpers that the corpus operators share: tables, shared folders, word rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import fresh_path, materialize, shared_dir  # noqa: F401

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A small table is broadcast up to so many rows (each a few hundred bytes at most).
BROADCAST_ROWS = 20_000
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_row(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, and all other columns in one struct __row, so that no name of theirs can clash with an operator's."""
    return docs.select(*keep, F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c not in keep]).alias("__row"))


def unpack_row(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in keep else F.col(f"__row.`{c}`").alias(c) for c in columns])


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python at most `BATCH_BYTES` bytes at once; texts may be long.

    The option stays set: plans are made when an action runs, which is after an operator has returned.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def text_slices(texts: list, chars: int) -> Iterator[slice]:
    """Slices of a list of texts (or nulls) of about so many characters each, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size >= chars:
            yield slice(at, i)
            at, size = i, 0
        size += len(t) if isinstance(t, str) else 0
    if at < len(texts):
        yield slice(at, len(texts))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for broadcast if its counted rows are within the bound; else leave the choice to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def in_slices(total_rows: int, rows_each: int) -> int:
    return max(1, -(-total_rows // rows_each))


def slots_for(spark: SparkSession, n: int) -> list[int]:
    """n numbers that `repartition(n, number)` deals to n different tasks."""
    at = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(n * 40).groupBy(at.alias("task")).agg(F.min("id").alias("id")).collect()
    some = {r["task"]: r["id"] for r in found}
    return [some.get(i, i) for i in range(n)]


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, bucket: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each row, within `group`, by (`bucket`, `order`), as `out`.

    `bucket` must be monotone in `order` within a group. Only one bucket's rows meet in a task: bucket
    totals are pre-aggregated, their prefix sums joined back. Hot groups are thus spread over all tasks.
    """
    from pyspark.sql import Window as W

    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(totals, [*group, bucket])
    return joined.withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__base")
