"""Vocabulary and spelling recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_digit, normalize, token_list

#: Batches of queries within this bound are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000


Hint = Callable[[DataFrame], DataFrame]


def no_hint(df: DataFrame) -> DataFrame:
    return df


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by shuffle on both sides: the size of what derives from a catalogue is estimated from its files, which may be
    a hundredth of its rows, so the planner would broadcast it."""
    return df.hint("merge")


def batch_hint(queries: DataFrame) -> Hint:
    """Broadcasts what derives from a batch of queries if the batch is small (counted up to the bound only), else shuffles."""
    return F.broadcast if queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled


def vocabulary(catalog: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """word, doc_freq: products that hold the word in name, brand, category or description; words of three letters or
    more without digits. Each synonym and each category that it stands for counts once more."""
    tokens = F.array_distinct(F.concat("name_tokens", "brand_tokens", F.split("category_norm", " "), "desc_tokens"))
    words = catalog.select(F.explode(tokens).alias("word")).where((F.length("word") >= 3) & ~contains_digit(F.col("word")))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if synonyms is not None:
        more = synonyms.select("word").distinct().union(synonyms.select("category_norm")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.union(more)
    return counts.groupBy("word").agg(F.sum("n").cast("long").alias("doc_freq"))


def _segment(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """0-based start and length of the i-th of `parts` even segments of a word; the last ones are the longer."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    late = F.greatest(i - (parts - longer), F.lit(0))
    return i * base + late, base + (i >= parts - longer).cast("int")


def near_words(terms: DataFrame, words: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """terms: term, most (0 to 2); words: word, both distinct -> term, word, distance of every pair within `most`.

    If two words are within `most` edits, one of the word's most + 1 segments stands in the term too, at most `most`
    places off. So words lie under their segments, terms ask with what may be one, and only these pairs are compared.
    """
    word, n = F.col("word"), F.length("word")
    parts = F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: k <= F.greatest(n, F.lit(1)))
    held = words.select("word", n.alias("n"), F.explode(parts).alias("parts"))
    held = held.select("word", "n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    start, size = _segment(F.col("n"), F.col("parts"), F.col("i"))
    held = held.select("word", "n", "parts", "i", F.substring(word, start + 1, size).alias("piece"))

    asked = terms.select("term", "most", F.explode(F.filter(F.sequence(F.length("term") - F.col("most"), F.length("term") + F.col("most")), lambda x: x > F.lit(0))).alias("n"))
    asked = asked.withColumn("parts", F.col("most") + 1).where("n >= parts").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    asked = asked.withColumn("off", F.explode(F.sequence(-F.col("most"), F.col("most"))))
    start, size = _segment(F.col("n"), F.col("parts"), F.col("i"))
    asked = asked.withColumn("start", start + F.col("off")).withColumn("size", size).where("start >= 0 and start + size <= length(term)")
    asked = asked.select("term", "most", "n", "parts", "i", F.substring("term", F.col("start") + 1, F.col("size")).alias("piece")).distinct()
    near = held.join(hint(asked), ["n", "parts", "i", "piece"]).withColumn("distance", F.levenshtein("term", "word", 2))
    return near.where((F.col("distance") >= 0) & (F.col("distance") <= F.col("most"))).select("term", "word", "distance").distinct()


def corrections(terms: DataFrame, vocab: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """term -> corrected, distance: only terms that change. `terms`: distinct terms.

    The word of the least (distance, -frequency, word) is taken, at a distance of 1 for terms of up to four letters,
    else 2; the vocabulary's words have three letters or more.
    """
    open_terms = terms.where((F.length("term") >= 3) & ~contains_digit(F.col("term")))
    known = vocab.select(F.col("word").alias("term")).join(hint(open_terms), "term", "left_semi")
    open_terms = open_terms.join(hint(known), "term", "left_anti")
    open_terms = open_terms.withColumn("most", F.when(F.length("term") <= 4, 1).otherwise(2))
    near = near_words(open_terms, vocab.select("word"), hint)
    near = vocab.join(hint(near), "word")
    best = F.min(F.struct("distance", (-F.col("doc_freq")).alias("f"), "word")).alias("b")
    return near.groupBy("term").agg(best).select("term", F.col("b.word").alias("corrected"), F.col("b.distance").alias("distance"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, query_text -> query_id, pos, term of the normalised text; empty queries have none."""
    return queries.select("query_id", F.posexplode(token_list(normalize(F.col("query_text")))).alias("pos", "term"))


def correct(terms: DataFrame, vocab: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """query_id, pos, term -> and corrected, distance (0 if unchanged)."""
    changed = corrections(terms.select("term").distinct(), vocab, hint)
    out = terms.join(hint(changed), "term", "left")
    return out.select("query_id", "pos", "term", F.coalesce("corrected", "term").alias("corrected"), F.coalesce("distance", F.lit(0)).alias("distance"))


def spelling_report(corrected: DataFrame) -> DataFrame:
    """The words that were changed, in order."""
    order = W.partitionBy("query_id").orderBy("pos")
    changed = corrected.where("term <> corrected")
    return changed.withColumn("change_no", F.row_number().over(order)).select("query_id", "change_no", "pos", "term", "corrected", "distance")
