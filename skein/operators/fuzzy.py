"""Approximate lookup by edit distance, where search finds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_digit, normalize, strip_control
from ..sources.staging import materialize
from .spelling import Hint, batch_hint, near_words, no_hint, query_terms, shuffled

SHOWN = 10


def threshold(term):
    """0 for terms of two letters or with a digit, 1 up to eight letters, else 2."""
    return F.when((F.length(term) <= 2) | contains_digit(term), 0).when(F.length(term) <= 8, 1).otherwise(2)


def near_tokens(terms: DataFrame, tokens: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """term, token, distance within the term's threshold; both sides distinct."""
    asked = terms.withColumn("most", threshold(F.col("term")))
    return near_words(asked, tokens.select(F.col("token").alias("word")), hint).withColumnRenamed("word", "token")


def _best(terms: DataFrame, index: DataFrame, hint: Hint) -> DataFrame:
    """query_id, pos, corpus_pos -> the first of the nearest tokens."""
    near = near_tokens(terms.select("term").distinct(), index.select("token").distinct(), hint)
    hits = index.join(hint(near), "token").join(hint(terms), "term")
    best = F.min(F.struct("distance", "place", "token")).alias("b")
    return hits.groupBy("query_id", "pos", "corpus_pos").agg(best).select("query_id", "pos", "corpus_pos", F.col("b.distance").alias("distance"), F.col("b.token").alias("token"))


def _places(catalog: DataFrame, column: str) -> DataFrame:
    """token, corpus_pos, its first place."""
    return catalog.select("corpus_pos", F.posexplode(column).alias("place", "token")).groupBy("corpus_pos", "token").agg(F.min("place").alias("place"))


def fuzzy_search(catalog: DataFrame, queries: DataFrame, limit: int | None = SHOWN) -> DataFrame:
    """catalog: corpus_pos, product_name, name_list, content_list (words in order).

    Each query term takes the nearest word of the name, or, in queries of several terms, of the content. A product
    stays if one term matches (two of three or more).
    """
    hint = batch_hint(queries)
    terms = query_terms(queries)
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    by_name = _best(terms, _places(catalog, "name_list"), hint)
    several = terms.join(hint(sizes.where("terms > 1").select("query_id")), "query_id", "left_semi")
    by_content = _best(several, _places(catalog, "content_list"), hint).join(by_name.select("query_id", "pos", "corpus_pos"), ["query_id", "pos", "corpus_pos"], "left_anti")
    every = by_name.union(by_content)
    matched = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), ", ")
    per = every.groupBy("query_id", "corpus_pos").agg(F.count(F.lit(1)).alias("matched_terms"), F.sum("distance").alias("distance"), matched.alias("matched"))
    per = per.join(hint(sizes.join(queries, "query_id")), "query_id").where(F.col("matched_terms") >= F.when(F.col("terms") >= 3, 2).otherwise(1))
    per = shuffled(per).join(catalog.select("corpus_pos", "product_name"), "corpus_pos")
    bonus = F.when(F.contains(F.lower("product_name"), F.lower("query_text")), 30.0).otherwise(0.0)
    score = F.col("matched_terms") / F.col("terms") * 100.0 - F.col("distance") * 5.0 + bonus
    per = per.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "corpus_pos")
    out = per.withColumn("rank", F.row_number().over(order))
    out = out if limit is None else out.where(F.col("rank") <= limit)
    return out.select("query_id", "rank", "corpus_pos", "product_name", "matched", F.col("distance").cast("int"), F.col("matched_terms").cast("int"), F.col("terms").cast("int"), "score", F.format_string("%.2f", "score").alias("score_text"))


def fallback(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries with a word that search found nothing for, with their text as it was typed, trimmed."""
    asked = queries.where(normalize(F.col("query_text")) != "").withColumn("query_text", strip_control(F.col("query_text")))
    # A few rows that fuzzy search reads in several branches: written, so that the search isn't run for each.
    return materialize(asked.join(found.select("query_id").distinct(), "query_id", "left_anti"), "fallback")
