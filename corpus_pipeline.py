"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents. A stage's result is written before the next one reads it.

Defined cases, in every stage: null and empty texts are copies of one another, of which the stage of near copies keeps
one, and mixing takes none, as they have no words; texts of any length are read whole; a null doc_id is a document too; rows repeated whole are copies;
an empty table gives an empty result; further columns are kept, whatever their names, but for the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import mixing, near_copies, packing, substrings, toxicity
from skein.llm.common import materialize, table


#: Of the tokenizer's table in each worker; see pack.
CHUNKS_KEPT = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores at 0.5 or more go."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("__score") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard 0.8 or more) stays, the one with the smallest doc_id."""
    return near_copies.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 100 bytes that also starts earlier go; documents stay, shortened."""
    return substrings.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to their sources' targets, in training order; some several times, some not."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    The stages before leave more workers to an executor than it has cores; each takes a table of chunks, so it is small.
    """
    return packing.pack(docs, kept=CHUNKS_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, suffix arrays and tokens can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
