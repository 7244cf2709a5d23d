"""One object for a catalogue: the index is built once and kept, queries come in batches or one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize, strip_control
from .operators import catalog, fuzzy, prefix, recommend, search, spelling
from .plans import benchmark
from .sources import corpus, index
from .sources.staging import materialize


class Engine:
    """Search, spelling, prefix lookup, fuzzy lookup and recommendations over one corpus."""

    def __init__(self, spark: SparkSession, documents: DataFrame, intent: dict | None = None, synonyms: dict | None = None):
        """documents: corpus_pos, file_name, content."""
        self._set(spark, catalog.from_corpus(documents).persist(), intent, synonyms)
        self.postings = catalog.postings(self.catalog).persist()
        self.vocabulary = spelling.vocabulary(self.catalog, self.synonyms).persist()
        self.index = prefix.prefix_index(self.catalog, "product_name", "index_text").persist()

    def _set(self, spark: SparkSession, products: DataFrame, intent: dict | None, synonyms: dict | None) -> None:
        self.spark, self.catalog = spark, products
        self.intent, self.synonyms = catalog.intent_table(spark, intent), catalog.synonym_table(spark, synonyms)

    @classmethod
    def open(cls, spark: SparkSession, path: str = "corpus", **options) -> Engine:
        return cls(spark, corpus.load_corpus(spark, path), **options)

    def write_index(self, path: str) -> int:
        """Keep what search reads as a new version of an index on disk; its number."""
        kept = [
            index.Kept("catalog", self.catalog, ("corpus_pos",)),
            index.Kept("postings", self.postings, ("field", "token"), ("field", "token", "corpus_pos")),
            index.Kept("vocabulary", self.vocabulary, ("word",)),
            index.Kept("words", self.index, ("word",), ("word", "corpus_pos")),
        ]
        return index.write(self.spark, path, kept)

    @classmethod
    def open_index(cls, spark: SparkSession, path: str, version: int | None = None, intent: dict | None = None, synonyms: dict | None = None) -> Engine:
        """An engine on a written index (the newest version, if none is given): nothing is parsed or counted again.

        `synonyms` should be those the index was written with, as its vocabulary counts them.
        """
        kept = index.load(spark, path, version)
        e = cls.__new__(cls)
        e._set(spark, kept["catalog"], intent, synonyms)
        e.postings, e.vocabulary, e.index = kept["postings"], kept["vocabulary"], kept["words"]
        return e

    def queries(self, *texts: str | None) -> DataFrame:
        return self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query_text string")

    def prepare(self, queries: DataFrame) -> DataFrame:
        """What each query was understood as: corrected words, intent, algorithm label."""
        return search.prepare(queries, self.vocabulary, self.intent, spelling.batch_hint(queries))

    def changes(self, queries: DataFrame) -> DataFrame:
        return spelling.spelling_report(spelling.correct(spelling.query_terms(queries), self.vocabulary, spelling.batch_hint(queries)))

    def rank(self, queries: DataFrame, limit: int = search.SHOWN) -> DataFrame:
        """The best products of each query, with what is shown of them."""
        hint = spelling.batch_hint(queries)
        found = search.scores(self.catalog, materialize(self.prepare(queries), "prepared"), self.synonyms, hint, self.postings)
        best = self.catalog.join(hint(search.ranked(found, limit)), "corpus_pos")
        return best.select("query_id", "rank", "corpus_pos", "product_name", "file_name", "price", "rating", "info", "rec_category", "brand", "score", "total_matches")

    def fuzzy(self, queries: DataFrame, limit: int | None = fuzzy.SHOWN) -> DataFrame:
        return fuzzy.fuzzy_search(self.catalog, queries, limit)

    def fallback(self, queries: DataFrame, found: DataFrame) -> DataFrame:
        """Fuzzy results for the queries that `found` has nothing for."""
        return self.fuzzy(fuzzy.fallback(queries, found))

    def recommend(self, queries: DataFrame, **limits) -> DataFrame:
        """The decision on each query's best candidates; see operators.recommend for its reports."""
        pool = self.rank(queries, search.POOL)
        return recommend.decide(pool.select("query_id", "rank", "product_name", F.col("rec_category").alias("category"), "brand", "score"), **limits)

    def words(self, *prefixes: str) -> DataFrame:
        asked = self.spark.createDataFrame([(p,) for p in prefixes], "prefix string")
        return prefix.complete(self.index.select("word").distinct(), asked)

    def products_by_prefix(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        found = prefix.search_prefix(self.index, queries, limit)
        return found.join(self.catalog.select("corpus_pos", "product_name", "file_name"), "corpus_pos")

    def count_pattern(self, pattern: str) -> dict:
        """Overlapping occurrences of a pattern in all texts, by two plans, timed."""
        norm = self.spark.range(1).select(normalize(F.lit(pattern))).first()[0]
        return benchmark.compare(self.catalog, "pattern_text", norm)

    def clean(self, text: str) -> str:
        return self.spark.range(1).select(strip_control(F.lit(text))).first()[0]
