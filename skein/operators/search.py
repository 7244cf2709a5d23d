"""Field-weighted relevance search for batches of queries.

Query terms meet the distinct tokens of each field, never products: what may match a token (plurals, model numbers,
compound ends) is written out as variants of the token, so every match is an equi-join. Matches then meet the
postings; points are summed per term, then per product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import materialize
from .catalog import postings
from .spelling import Hint, batch_hint, correct, no_hint, query_terms, shuffled, vocabulary

SHOWN, POOL = 10, 30
#: Points.
EXACT_NAME, IN_NAME = 300, 220
NAME, BRAND, CATEGORY, DESCRIPTION = 100, 80, 180, 10
ALL_STRONG, ALL_MATCHED = 200, 150
RIGHT_CATEGORY, WRONG_CATEGORY = 250, -180
PHRASE = 50


def prepare(queries: DataFrame, vocab: DataFrame, intent: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """One row per query with a word: corrected_query, terms (unique, in order), phrase, algorithm, intent."""
    words = correct(query_terms(queries), vocab, hint)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term", "corrected")))
    per = words.groupBy("query_id").agg(ordered.alias("w"))
    per = per.select(
        "query_id",
        F.array_join(F.transform("w", lambda x: x["term"]), " ").alias("normalized_query"),
        F.array_join(F.transform("w", lambda x: x["corrected"]), " ").alias("corrected_query"),
        F.array_distinct(F.transform("w", lambda x: x["corrected"])).alias("terms"),
    )
    per = per.withColumn("phrase", F.array_join("terms", " "))
    per = per.withColumn("algorithm", F.when((F.length("phrase") <= 8) | (F.size("terms") <= 2), "KMP").otherwise("Rabin-Karp"))
    asked = per.select("query_id", F.posexplode("terms").alias("pos", "word")).join(intent, "word")
    asked = asked.groupBy("query_id").agg(F.min_by("category", "pos").alias("intent"))
    return per.join(asked, "query_id", "left").withColumn("intent", F.coalesce("intent", F.lit("")))


def _name_variants(token: Column) -> Column:
    """Terms that a name token matches: itself, without closing digits, its plural and singular, its ends."""
    n = F.length(token)
    digits = F.length(F.regexp_extract(token, "[0-9]*$", 0))
    cut = F.filter(F.transform(F.sequence(F.lit(0), digits), lambda k: F.substring(token, F.lit(1), n - k)), lambda v: F.length(v) >= 3)
    ends = F.transform(F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0))), lambda k: F.substring(token, k + F.lit(1), n))
    plural = F.array(F.concat(token, F.lit("s")), F.when(F.endswith(token, F.lit("s")), F.substring(token, F.lit(1), n - 1)))
    four = F.filter(F.concat(ends, plural), lambda v: F.length(v) >= 4)
    return F.array_distinct(F.concat(F.array(token), cut, four))


def _plural_variants(token: Column) -> Column:
    """Terms that a token matches by equality, or with four letters or more by an s more or less."""
    plural = F.array(F.concat(token, F.lit("s")), F.when(F.endswith(token, F.lit("s")), F.substring(token, F.lit(1), F.length(token) - 1)))
    return F.array_distinct(F.concat(F.array(token), F.filter(plural, lambda v: F.length(v) >= 4)))


def token_variants(tokens: DataFrame, synonyms: DataFrame) -> DataFrame:
    """field, token (distinct) -> field, token, term that matches it."""
    token, field = F.col("token"), F.col("field")
    variants = F.when(field == "name", _name_variants(token)).when(field == "brand", F.array(token)).otherwise(_plural_variants(token))
    own = tokens.select("field", "token", F.explode(variants).alias("term"))
    other = tokens.where(field == "category").join(F.broadcast(synonyms), F.col("token") == F.col("category_norm"))
    return own.union(other.select("field", "token", F.col("word").alias("term"))).distinct()


def asked_tokens(terms: DataFrame, tokens: DataFrame, synonyms: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """query_id, term, field, token of every token that a term matches, to be joined with postings: written and counted, so
    that few are broadcast and many shuffled, but postings never broadcast."""
    hits = materialize(token_variants(tokens, synonyms).join(hint(terms), "term"), "hits")
    return batch_hint(hits)(hits)


def matches(prepared: DataFrame, index: DataFrame, synonyms: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """query_id, term, corpus_pos and which fields match: name, brand, category, description."""
    terms = prepared.select("query_id", F.explode("terms").alias("term"))
    hits = index.join(asked_tokens(terms, index.select("field", "token").distinct(), synonyms, hint), ["field", "token"])
    flags = [F.max((F.col("field") == f).cast("int")).alias(f) for f in ("name", "brand", "category", "description")]
    return hits.groupBy("query_id", "term", "corpus_pos").agg(*flags)


#: What the score of a match is made from; the rest of a product is fetched once the best are known.
SCORED = ("corpus_pos", "name_norm", "phrase_text", "rec_category", "rating_num", "product_name")


def scores(catalog: DataFrame, prepared: DataFrame, synonyms: DataFrame, hint: Hint = no_hint, index: DataFrame | None = None) -> DataFrame:
    """query_id, corpus_pos, score > 0 and what ranks them. index: postings(catalog), if they are kept."""
    found = matches(prepared, postings(catalog) if index is None else index, synonyms, hint)
    # A product of the asked category may score without any matching term.
    asked = hint(prepared.where("intent <> ''").select("query_id", F.lower("intent").alias("k")))
    wanted = catalog.select("corpus_pos", F.lower("rec_category").alias("k")).join(asked, "k").select("query_id", "corpus_pos")
    return scored(catalog, found, wanted, prepared, hint)


def term_points(name: Column, brand: Column, category: Column, description: Column) -> Column:
    return NAME * name + BRAND * brand + CATEGORY * category + DESCRIPTION * description


def all_terms(n: Column, strong: Column, matched: Column) -> Column:
    """The bonus for matching every one of several terms."""
    return F.when(n <= 1, 0).when(strong == n, ALL_STRONG).when(matched == n, ALL_MATCHED).otherwise(0)


def scored(catalog: DataFrame, found: DataFrame, wanted: DataFrame, prepared: DataFrame, hint: Hint = no_hint) -> DataFrame:
    """The scores of these matches and of the products `wanted` (query_id, corpus_pos) for their category."""
    strong = F.greatest("name", "brand", "category")
    points = term_points(F.col("name"), F.col("brand"), F.col("category"), F.col("description"))
    per = found.groupBy("query_id", "corpus_pos").agg(F.sum(points).alias("points"), F.sum(strong).alias("strong"), F.sum(F.when(strong == 0, F.col("description")).otherwise(0)).alias("weak"))
    none = F.lit(0).cast("long")
    both = per.unionByName(wanted.select("query_id", "corpus_pos", none.alias("points"), none.alias("strong"), none.alias("weak")))
    per = both.groupBy("query_id", "corpus_pos").agg(*[F.sum(c).alias(c) for c in ("points", "strong", "weak")])
    whole = catalog.select(*SCORED).join(shuffled(per), "corpus_pos").join(hint(prepared), "query_id")
    padded = F.concat(F.lit(" "), "phrase", F.lit(" "))
    name = F.when(F.col("name_norm") == F.col("phrase"), EXACT_NAME).when(F.contains(F.concat(F.lit(" "), "name_norm", F.lit(" ")), padded), IN_NAME).otherwise(0)
    bonus = all_terms(F.size("terms"), F.col("strong"), F.col("strong") + F.col("weak"))
    asked = F.when(F.col("intent") == "", 0).when(F.lower("rec_category") == F.lower("intent"), RIGHT_CATEGORY).otherwise(WRONG_CATEGORY)
    phrase = F.when(F.contains("phrase_text", padded), PHRASE).otherwise(0)
    nothing = (F.col("strong") == 0) & (F.col("weak") == 0) & (F.col("intent") == "")
    score = F.when(nothing, 0).otherwise(F.greatest(name + F.col("points") + bonus + asked + phrase, F.lit(0)))
    return whole.select("query_id", "corpus_pos", "rating_num", "product_name", score.cast("int").alias("score")).where("score > 0")


def best(scores: DataFrame, limit: int) -> DataFrame:
    """The best `limit` of each query, with rank."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rating_num"), F.lower("product_name"), "corpus_pos")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def ranked(scores: DataFrame, limit: int = SHOWN) -> DataFrame:
    """query_id, rank, corpus_pos, score and total_matches, the number of all matches."""
    # Read by the count and by the ranking: written, so that matches are scored once.
    kept = materialize(scores, "scores")
    totals = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_matches"))
    return best(kept, limit).join(totals, "query_id").select("query_id", "rank", "corpus_pos", "score", "total_matches")


def search(catalog: DataFrame, queries: DataFrame, intent: DataFrame, synonyms: DataFrame, limit: int = SHOWN) -> DataFrame:
    """query_id, query_text -> query_id, rank, corpus_pos, product_name, rec_category, brand, score, total_matches."""
    hint = batch_hint(queries)
    # One small row per query, used by several branches: written, so that the vocabulary is built once.
    prepared = materialize(prepare(queries, vocabulary(catalog, synonyms), intent, hint), "prepared")
    top = ranked(scores(catalog, prepared, synonyms, hint), limit)
    shown = catalog.select("corpus_pos", "product_name", "rec_category", "brand").join(hint(top), "corpus_pos")
    return shown.select("query_id", "rank", "corpus_pos", "product_name", "rec_category", "brand", "score", "total_matches")
