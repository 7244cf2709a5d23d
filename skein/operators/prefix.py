"""Prefix lookup of words, and of products by the prefixes of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize, strip_control, token_list
from ..sources.staging import materialize
from .spelling import Hint, batch_hint, no_hint, shuffled

#: Products that are numbered in one task.
BUCKET = 50_000


def clean(word: Column) -> Column:
    return strip_control(F.lower(word))


def words(table: DataFrame, column: str) -> DataFrame:
    """word: distinct, lower case, blanks left out."""
    return table.select(clean(F.col(column)).alias("word")).where(F.col("word") != "").distinct()


def has_word(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: word -> word, found."""
    keyed = asked.select("word", clean(F.col("word")).alias("__w"))
    hint = batch_hint(asked)
    # At most the words asked for, so the vocabulary isn't broadcast.
    known = vocabulary.select(F.col("word").alias("__w")).join(hint(keyed.select("__w").distinct()), "__w", "left_semi").withColumn("__k", F.lit(True))
    return keyed.join(hint(known), "__w", "left").select("word", F.coalesce("__k", F.lit(False)).alias("found"))


def _by_prefix(vocabulary: DataFrame, prefixes: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """__p (cleaned prefix), word: words meet prefixes by each of their beginnings, as an equi-join."""
    begun = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("__p"))
    return begun.join(hint(prefixes.select("__p").where("__p <> ''").distinct()), "__p")


def complete(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: prefix -> prefix, position, word: the words that begin with it, in alphabetical order."""
    keyed = asked.select("prefix", clean(F.col("prefix")).alias("__p"))
    hint = batch_hint(asked)
    found = _by_prefix(vocabulary, keyed, hint).join(hint(keyed), "__p")
    order = W.partitionBy("prefix").orderBy("word")
    return found.select("prefix", F.row_number().over(order).alias("position"), "word")


def has_prefix(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: prefix -> prefix, found; blank prefixes are not found."""
    keyed = asked.select("prefix", clean(F.col("prefix")).alias("__p"))
    known = _by_prefix(vocabulary, keyed, batch_hint(asked)).select("__p").distinct().withColumn("__k", F.lit(True))
    return keyed.join(known, "__p", "left").select("prefix", F.coalesce("__k", F.lit(False)).alias("found"))


def prefix_index(catalog: DataFrame, *columns: str) -> DataFrame:
    """word, corpus_pos: words of two letters or more of the given text columns, distinct."""
    every = F.flatten(F.array(*[token_list(normalize(F.col(c))) for c in columns]))
    return catalog.select("corpus_pos", F.explode(F.array_distinct(every)).alias("word")).where(F.length("word") >= 2)


def _ranked(found: DataFrame) -> DataFrame:
    """query_id, corpus_pos, __first -> and rank, total. Written and read twice.

    A query may find every product, so its rows are numbered by buckets of products; the rows before a bucket are added up from
    its buckets' counts.
    """
    found = materialize(found.select("query_id", "corpus_pos", "__first", F.coalesce(F.floor(F.col("corpus_pos") / BUCKET), F.lit(-(2**63))).alias("__b")), "prefixed")
    keys = ["query_id", "__first", "__b"]
    counts = found.groupBy(keys).agg(F.count(F.lit(1)).alias("n"))
    query = W.partitionBy("query_id")
    before = F.sum("n").over(query.orderBy("__first", "__b")) - F.col("n")
    counts = counts.select(*keys, before.alias("before"), F.sum("n").over(query).alias("total"))
    rows = found.withColumn("place", F.row_number().over(W.partitionBy(keys).orderBy("corpus_pos")))
    return rows.join(shuffled(counts), keys).select("query_id", (F.col("before") + F.col("place")).alias("rank"), "corpus_pos", "total")


def search_prefix(index: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, query_text -> query_id, rank, corpus_pos, total: products that have a word for each prefix.

    Products come in the order of the first prefix's smallest matching word, then of the corpus.
    """
    hint = batch_hint(queries)
    parts = queries.select("query_id", F.posexplode(token_list(normalize(F.col("query_text")))).alias("part", "__p"))
    sizes = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("__parts"))
    matching = _by_prefix(index.select("word").distinct(), parts, hint).join(hint(parts), "__p").select("query_id", "part", "word")
    # Written and counted: few are broadcast and many shuffled, but the index never broadcast.
    matching = materialize(matching, "matching")
    hits = index.join(batch_hint(matching)(matching), "word")
    first = F.min(F.when(F.col("part") == 0, F.col("word"))).alias("__first")
    found = hits.groupBy("query_id", "corpus_pos").agg(F.countDistinct("part").alias("__n"), first)
    out = _ranked(found.join(hint(sizes), "query_id").where("__n = __parts"))
    return out if limit is None else out.where(F.col("rank") <= limit)
