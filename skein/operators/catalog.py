"""The catalogue contract: one row per product, with what search reads derived once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.dictionaries import INTENT, SYNONYMS
from ..functions.text import normalize, parse_rating, strip_control, token_list, token_set


def intent_table(spark: SparkSession, intent: dict | None = None) -> DataFrame:
    """word -> category that it asks for."""
    rows = [(w, c) for c, words in (INTENT if intent is None else intent).items() for w in words]
    return spark.createDataFrame(rows, "word string, category string")


def synonym_table(spark: SparkSession, synonyms: dict | None = None) -> DataFrame:
    """word -> normalised category that it is another word for."""
    rows = [(w, c) for c, words in (SYNONYMS if synonyms is None else synonyms).items() for w in words]
    return spark.createDataFrame(rows, "word string, category_norm string")


def derive(products: DataFrame, *keep: str) -> DataFrame:
    """corpus_pos, product_name, brand, category, description, rating -> the columns that search reads, and `keep`.

    A projection for each step: what a later one reads several times is a column by then.
    """
    name, brand, description = (F.coalesce(c, F.lit("")) for c in ("product_name", "brand", "description"))
    out = products.select(
        "corpus_pos", *keep,
        name.alias("product_name"),
        brand.alias("brand"),
        strip_control(F.coalesce("category", F.lit(""))).alias("__field"),
        parse_rating(F.coalesce(F.col("rating").cast("string"), F.lit(""))).alias("rating_num"),
        normalize(name).alias("name_norm"),
        normalize(brand).alias("brand_norm"),
        normalize(description).alias("description_norm"),
    )
    out = out.withColumn("__field_norm", normalize(F.col("__field")))
    out = out.withColumn("rec_category", fields.classify(F.col("__field"), F.col("__field_norm"), F.col("name_norm")))
    out = out.withColumn("category_norm", normalize(F.col("rec_category")))
    return out.select(
        "corpus_pos", *keep, "product_name", "brand", "rec_category", "rating_num", "name_norm", "category_norm", "description_norm",
        token_set(F.col("name_norm")).alias("name_tokens"),
        token_set(F.col("brand_norm")).alias("brand_tokens"),
        token_set(F.col("description_norm")).alias("desc_tokens"),
        F.concat(F.lit(" "), normalize(F.concat_ws(" ", "product_name", "brand", "rec_category", "description_norm")), F.lit(" ")).alias("phrase_text"),
        token_list(F.col("name_norm")).alias("name_list"),
    )


def from_corpus(corpus: DataFrame) -> DataFrame:
    """corpus_pos, file_name, content -> the catalogue, with display fields and the text that fuzzy search reads.

    Narrow projections only; write the result (or persist it) before it is searched, or each use parses anew.
    """
    parsed = fields.read(corpus.select("corpus_pos", "file_name", "content")).withColumnRenamed("clean", "description")
    parsed = parsed.select(
        "*",
        normalize(F.concat_ws(" ", "product_name", "brand", "category", "searchable")).alias("pattern_text"),
        token_list(normalize(fields.without_misspellings(F.lower("searchable")))).alias("content_list"),
        F.col("rating").alias("shown_rating"), F.col("category").alias("shown_category"),
    )
    out = derive(parsed, "file_name", "price", "shown_rating", "shown_category", "info", "index_text", "pattern_text", "content_list")
    return out.withColumnsRenamed({"shown_rating": "rating", "shown_category": "category"})


def from_part(part: DataFrame) -> DataFrame:
    """The `part` table as a catalogue: size stands for the rating."""
    return part.select(
        F.col("p_partkey").alias("corpus_pos"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("description"),
        F.col("p_size").cast("string").alias("rating"),
    )


def postings(catalog: DataFrame) -> DataFrame:
    """field, token, corpus_pos: the inverted index, distinct."""
    per_field = [("name", F.col("name_tokens")), ("brand", F.col("brand_tokens")), ("description", F.col("desc_tokens")), ("category", F.filter(F.array("category_norm"), lambda x: x != ""))]
    pairs = F.flatten(F.array(*[F.transform(tokens, _tagged(f)) for f, tokens in per_field]))
    return catalog.select("corpus_pos", F.explode(pairs).alias("p")).select("p.field", "p.token", "corpus_pos")


def _tagged(field: str):
    return lambda token: F.struct(F.lit(field).alias("field"), token.alias("token"))
