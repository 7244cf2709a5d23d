"""A sorted dictionary of words on disk, looked up by prefix in proportion to what matches.

Words are dealt to parts by range, a folder each, and sorted there; every `BLOCK_WORDS` of them are a block, of which the first
and last word are kept. The words that begin with p stand together, from p on. So a prefix is a run of parts (found
among the parts' first words, of which there are `MOST_PARTS` at most, whatever the number of words), in these a run of
blocks (an equi-join on the part, held to the blocks' ends), and only those blocks' words are compared with it. Parts
that no prefix needs aren't read.

Later words are a run of their own, sorted the same way: `insert` writes one, look-ups read all runs, and `compact` merges them
into one that replaces them. A run counts once its blocks are written, so readers never see half of one.

Defined cases: null and blank words are left out, the rest is lower-cased and stripped; words and prefixes asked for twice are
answered once each; a blank prefix matches nothing; words may be as long as texts; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.index import _files
from .prefix import clean, words
from .spelling import batch_hint

BLOCK_WORDS, PART_WORDS, MOST_PARTS = 1_024, 1_000_000, 4_096


@dataclass(frozen=True)
class Run:
    words: DataFrame  # word, part, block
    blocks: DataFrame  # part, block, first, last
    tops: tuple[str, ...]  # each part's first word, in order
    parts: tuple[int, ...]


@dataclass(frozen=True)
class Dictionary:
    spark: SparkSession
    path: str
    runs: tuple[Run, ...]
    number: int

    def insert(self, table: DataFrame, column: str = "word", **sizes) -> Dictionary:
        """With the words of a table as a further run."""
        _write(words(table, column), f"{self.path}/r{self.number + 1}_0", **sizes)
        return open_dictionary(self.spark, self.path)

    def compact(self, **sizes) -> Dictionary:
        """With all runs merged into one; the folders of the old ones stay for their readers."""
        if len(self.runs) > 1:
            _write(self.words(), f"{self.path}/r{self.number + 1}_{self.number}", **sizes)
        return open_dictionary(self.spark, self.path)

    def words(self) -> DataFrame:
        out = self.runs[0].words.select("word")
        for r in self.runs[1:]:
            out = out.union(r.words.select("word"))
        return out.distinct() if len(self.runs) > 1 else out

    def starting(self, prefixes: DataFrame) -> DataFrame:
        """prefixes: p (distinct, cleaned) -> p, word."""
        hint, asked = batch_hint(prefixes), prefixes.where("p <> ''")
        found = [_starting(r, asked, hint) for r in self.runs]
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out.distinct() if len(found) > 1 else out

    def complete(self, asked: DataFrame) -> DataFrame:
        """asked: prefix -> prefix, position, word, in alphabetical order."""
        keyed = asked.select("prefix", clean(F.col("prefix")).alias("p")).distinct()
        found = self.starting(keyed.select("p").distinct()).join(batch_hint(asked)(keyed), "p")
        return found.select("prefix", F.row_number().over(W.partitionBy("prefix").orderBy("word")).alias("position"), "word")

    def has_prefix(self, asked: DataFrame) -> DataFrame:
        keyed = asked.select("prefix", clean(F.col("prefix")).alias("p")).distinct()
        known = self.starting(keyed.select("p").distinct()).select("p").distinct().withColumn("__k", F.lit(True))
        return keyed.join(known, "p", "left").select("prefix", F.coalesce("__k", F.lit(False)).alias("found"))

    def has_word(self, asked: DataFrame) -> DataFrame:
        """asked: word -> word, found."""
        keyed = asked.select("word", clean(F.col("word")).alias("p")).distinct()
        known = self.starting(keyed.select("p").distinct()).where("word = p").select("p").withColumn("__k", F.lit(True))
        return keyed.join(known, "p", "left").select("word", F.coalesce("__k", F.lit(False)).alias("found"))


def build(table: DataFrame, column: str, path: str, **sizes) -> Dictionary:
    """A dictionary of a column's words, in a new folder."""
    _write(words(table, column), f"{path}/r1_0", **sizes)
    return open_dictionary(table.sparkSession, path)


def open_dictionary(spark: SparkSession, path: str) -> Dictionary:
    fs, p = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted((*map(int, n[1:].split("_")), n) for n in names if n[:1] == "r" and fs.exists(_files(spark, f"{path}/{n}/blocks/_SUCCESS")[1]))
    if not found:
        raise FileNotFoundError(f"no dictionary at {path}")
    replaced = max(r for _, r, _ in found)
    runs = tuple(_read(spark, f"{path}/{n}") for number, _, n in found if number > replaced)
    return Dictionary(spark, path, runs, found[-1][0])


def _write(distinct_words: DataFrame, path: str, part_words: int = PART_WORDS, block_words: int = BLOCK_WORDS) -> None:
    n = distinct_words.count()
    parts = max(1, min(MOST_PARTS, -(-n // part_words)))
    ranged = distinct_words.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "word")
    # The lower 33 bits of the id count a task's rows, which are in order by now.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged.withColumn("block", F.floor(row / F.lit(block_words)).cast("int")).write.partitionBy("part").parquet(f"{path}/words")
    kept = distinct_words.sparkSession.read.schema("word string, block int, part int").parquet(f"{path}/words")
    kept.groupBy("part", "block").agg(F.min("word").alias("first"), F.max("word").alias("last")).write.parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str) -> Run:
    kept = spark.read.schema("word string, block int, part int").parquet(f"{path}/words")
    blocks = spark.read.schema("part int, block int, first string, last string").parquet(f"{path}/blocks")
    tops = blocks.groupBy("part").agg(F.min("first").alias("first")).orderBy("part").collect()  # MOST_PARTS rows at most
    return Run(kept, blocks, tuple(r["first"] for r in tops), tuple(r["part"] for r in tops))


def _at_or_under(first: Column, p: Column) -> Column:
    """Whether what begins with p may stand at or after a block that starts with `first`: it starts by p, or with p."""
    return (first <= p) | F.startswith(first, p)


def _starting(run: Run, asked: DataFrame, hint) -> DataFrame:
    tops = F.array(*[F.lit(t) for t in run.tops]).cast("array<string>")
    # Parts lie in order: the last one that starts by p, up to the last one that starts with p.
    low = F.greatest(F.size(F.filter(tops, lambda t: t <= F.col("p"))), F.lit(1))
    high = F.size(F.filter(tops, lambda t: _at_or_under(t, F.col("p"))))
    number = F.array(*[F.lit(n) for n in run.parts]).cast("array<int>")
    parts = asked.select("p", F.explode(F.when(high >= low, F.slice(number, low, high - low + 1))).alias("part"))
    at = run.blocks.join(hint(parts), "part").where((F.col("last") >= F.col("p")) & _at_or_under(F.col("first"), F.col("p")))
    return run.words.join(hint(at.select("p", "part", "block")), ["part", "block"]).where(F.startswith("word", "p")).select("p", "word")
