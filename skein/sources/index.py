"""Tables of an index on disk: bucketed, sorted, versioned; opened in any later session.

A version is a folder `v<number>` with a folder per table and a list of the tables, which is written last: a version
without its list isn't there yet, and readers of an older one go on reading it. Opening registers each table with its
buckets in the session's catalogue, so joins and groupings on the bucket columns need no shuffle on the table's side, and
a filter on them reads only its buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket.
BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class Kept:
    """A table to keep: its rows, what deals them to buckets, the order within a bucket, how many buckets (by its counted
    rows, if not given), and whether rows are written where they are made (they aren't shuffled then; a bucket is a file of
    each task that has rows of it, so no more files than values if a value's rows are made by one task)."""

    name: str
    rows: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...] = ()
    buckets: int | None = None
    placed: bool = False


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under a folder, oldest first."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in found if fs.exists(_files(spark, f"{path}/v{v}/tables/_SUCCESS")[1]))


def _quoted(columns: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def write(spark: SparkSession, path: str, tables: list[Kept], bucket_rows: int = BUCKET_ROWS) -> int:
    """Write a new version and return its number."""
    fs, p = _files(spark, path)
    taken = [int(n[1:]) for n in ([s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []) if n[:1] == "v" and n[1:].isdigit()]
    version = max(taken, default=0) + 1
    known = []
    for t in tables:
        buckets = t.buckets or max(1, -(-t.rows.count() // bucket_rows))
        name = f"skein_{uuid.uuid4().hex}"
        # Dealt as buckets are, so that a bucket is one file.
        out = (t.rows if t.placed else t.rows.repartition(buckets, *t.by)).write.bucketBy(buckets, *t.by).sortBy(*(t.order or t.by))
        out.option("path", f"{path}/v{version}/{t.name}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # of the session's catalogue; the files stay
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.rows.schema)
        known.append((t.name, columns, buckets, list(t.by), list(t.order or t.by)))
    spark.createDataFrame(known, "name string, columns string, buckets int, `by` array<string>, `order` array<string>").coalesce(1).write.json(f"{path}/v{version}/tables")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (the newest, if not given) by name."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no index{'' if version is None else f' version {version}'} at {path}")
    at = f"{path}/v{found[-1] if version is None else version}"
    out = {}
    for t in spark.read.schema("name string, columns string, buckets int, `by` array<string>, `order` array<string>").json(f"{at}/tables").collect():
        name = f"skein_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({t['columns']}) USING parquet CLUSTERED BY ({_quoted(tuple(t['by']))}) SORTED BY ({_quoted(tuple(t['order']))}) INTO {t['buckets']} BUCKETS LOCATION '{at}/{t['name']}'")
        out[t["name"]] = spark.table(name)
    return out
