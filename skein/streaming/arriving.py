"""Documents that arrive, are replaced and deleted: postings and document frequencies kept by a stream.

A stream of (doc_id, version, text, deleted) is kept as runs: each micro-batch writes, for every event, the words of that
version under the batch's number, overwritten if it is tried again. Readers take each document's latest version of all runs;
`compact` takes it once, into a run that stands for all before it. A late version is a row that loses. So batches may
arrive in any order and be cut anywhere; what they add up to is the same.

The work of a batch grows with the documents in it, not with those kept: nothing kept is looked up, no state is held and
nothing is shuffled. Taking the latest shuffles one row per event since the last compaction, none if all runs are merged.
Frequencies are combined before they are shuffled, so a word that every document has is no hot key. Words have no spaces:
a set of them is kept as one text.

Defined cases: a null or empty text has no words; a null `deleted` is false; a null version is before all others; rows without
doc_id are one document; of equal versions that of the first batch stays, and within a batch the one with the most words,
then the greatest list of words, deletions last; a deleted document comes back with a later version; further columns aren't read;
without any batch both tables are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import contains_digit, normalize, token_set

EVENTS = "doc_id long, version long, text string, deleted boolean"
RUN = "doc_id long, version long, run long, size int, words string"
#: Before any version.
_NEVER = -(2**63)


def _words(events: DataFrame) -> DataFrame:
    """doc_id, version and its words, in order, as one text; size: how many."""
    gone = F.coalesce("deleted", F.lit(False))
    own = F.when(gone, F.array().cast("array<string>")).otherwise(token_set(normalize(F.col("text"))))
    rows = events.select("doc_id", F.coalesce("version", F.lit(_NEVER + 1)).alias("version"), own.alias("own"))
    return rows.select("doc_id", "version", F.size("own").alias("size"), F.array_join(F.sort_array("own"), " ").alias("words"))


def keep(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start keeping the postings of a stream of events under `path`; `once` takes what is there now and ends."""

    def write(batch: DataFrame, number: int) -> None:
        run = _words(batch).select("doc_id", "version", F.lit(number).cast("long").alias("run"), "size", "words")
        run.write.mode("overwrite").parquet(f"{path.rstrip('/')}/runs/run={number}")

    writer = events.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The runs that are whole: their folders hold a mark of success."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/run=*/_SUCCESS")) if system.exists(place) else []
    return sorted(int(m.getPath().getParent().getName()[4:]) for m in marks or [])


def _latest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Every document's latest version of all runs, as a row of a run, and the number of the last run (-1 without any)."""
    path = path.rstrip("/")
    merged, runs = _numbers(spark, f"{path}/merged"), _numbers(spark, f"{path}/runs")
    upto = merged[-1] if merged else -1
    later = [n for n in runs if n > upto]
    paths = [f"{path}/merged/run={upto}"] * bool(merged) + [f"{path}/runs/run={n}" for n in later]
    if not paths:
        return spark.createDataFrame([], RUN), -1
    # A run's number is a column of it, and stays with a row when runs are merged; the folder's name isn't asked.
    rows = spark.read.schema(RUN).option("recursiveFileLookup", "true").parquet(*paths)
    if later:
        last = F.max(F.struct("version", (-F.col("run")).alias("first"), "size", "words")).alias("r")
        rows = rows.groupBy("doc_id").agg(last).select("doc_id", "r.version", (-F.col("r.first")).alias("run"), "r.size", "r.words")
    return rows, max([upto, *runs])


def postings(spark: SparkSession, path: str) -> DataFrame:
    """word, doc_id of the documents as they are now."""
    return _latest(spark, path)[0].where("size > 0").select(F.explode(F.split("words", " ")).alias("word"), "doc_id")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word, doc_freq: words of three letters or more without digits."""
    words = _latest(spark, path)[0].where("size > 0").select(F.explode(F.split("words", " ")).alias("word"))
    words = words.where((F.length("word") >= 3) & ~contains_digit(F.col("word")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"))


def compact(spark: SparkSession, path: str) -> None:
    """Take all runs so far together, as one run that readers take in their place; the stream may go on meanwhile."""
    rows, last = _latest(spark, path)
    if last >= 0 and last not in _numbers(spark, f"{path.rstrip('/')}/merged"):
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/merged/run={last}")
