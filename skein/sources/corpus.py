"""Directories of text files as a table, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField("corpus_pos", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("content", T.StringType())])


def clean_content(raw: Column) -> Column:
    """Bytes as text: malformed UTF-8 replaced, line ends made \\n, and one at the end."""
    text = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def with_order(files: DataFrame) -> DataFrame:
    """corpus_pos: 0, 1, ... by file name without case, then with.

    Names are counted by their first characters, so that only equal beginnings are ordered in one task.
    """
    keyed = files.withColumn("__low", F.lower("file_name")).withColumn("__head", F.substring(F.lower("file_name"), 1, 12))
    heads = keyed.groupBy("__head").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__head").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("__head", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(W.partitionBy("__head").orderBy("__low", "file_name"))
    return keyed.join(heads, "__head").withColumn("corpus_pos", (F.col("__base") + inside - 1).cast("long")).drop("__low", "__head", "__base")


def load_corpus(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    """corpus_pos, file_name, content of the text files of a folder (not of folders in it).

    Files are read whole by Spark's binary source. It leaves out files without bytes, so those are added from the
    folder's listing. A folder that isn't there raises FileNotFoundError with its path.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        raise FileNotFoundError(f"no folder at {system.makeQualified(place).toString()}")
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"[^/]*$", 0).alias("file_name"), clean_content(F.col("content")).alias("content"))
    blank = [s.getPath().getName() for s in system.listStatus(place) if s.isFile() and s.getLen() == 0]
    blank = [(n, "") for n in blank if n.lower().endswith(f".{extension.lower()}")]
    if blank:
        files = files.union(spark.createDataFrame(blank, "file_name string, content string"))
    return with_order(files).select("corpus_pos", "file_name", "content")


def from_rows(spark: SparkSession, rows) -> DataFrame:
    """A corpus from (file_name, content) pairs, kept in their order; None is an empty corpus, null rows are skipped."""
    own = [(i, n, c or "") for i, (n, c) in enumerate(r for r in (rows or []) if r is not None)]
    return spark.createDataFrame(own, RAW)
