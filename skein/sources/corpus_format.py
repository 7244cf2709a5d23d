"""The files of a folder as a data source: `spark.read.format("corpus")`, `spark.readStream.format("corpus")`.

    spark.dataSource.register(CorpusSource)
    spark.read.format("corpus").option("path", folder).option("extension", "txt").load()

Rows are corpus_pos, file_name and the file's bytes as `raw`; `load` cleans them as load_corpus does. The driver lists the folder
(names and sizes only, as any file source does), numbers the files, and plans partitions of about `partitionBytes`;
tasks read the bytes. With the option `filters` (set by `load` where spark.sql.python.filterPushdown.enabled is), equality, IN and
prefix filters on file_name leave files unread; positions stay those of the whole folder.

As a stream, an offset is the latest change time that was listed, and a batch is the files changed after the offset
before, up to its own; corpus_pos is null there, as order isn't known yet. A file is expected to appear whole (written
elsewhere, then moved in), and files of one instant together.

Defined cases: empty files are rows with empty bytes; folders in the folder and other extensions are left out; no files give
no rows; a folder that isn't there raises FileNotFoundError.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

from .corpus import clean_content

SCHEMA = "corpus_pos long, file_name string, raw binary"


@dataclass
class Files(InputPartition):
    files: list[tuple[int | None, str]]


class _Folder:
    def __init__(self, options: dict):
        self.path, self.extension = options["path"], options.get("extension", "txt").lower()
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def listed(self) -> list[tuple[str, int, int]]:
        """file_name, bytes, change time in nanoseconds; by name without case, then with."""
        from pyarrow import fs

        system, at = self.system()
        if system.get_file_info(at).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder at {self.path}")
        found = [(f.base_name, f.size, f.mtime_ns or 0) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        return sorted((f for f in found if f[0].lower().endswith(f".{self.extension}")), key=lambda f: (f[0].lower(), f[0]))

    def planned(self, files: list[tuple[int | None, str, int]]) -> list[Files]:
        """Partitions of at most so many bytes, or of one file; a file counts 4 KiB more for being opened."""
        parts, size = [Files([])], 0
        for pos, name, n in files:
            if parts[-1].files and size + n + 4096 > self.most:
                parts.append(Files([]))
                size = 0
            parts[-1].files.append((pos, name))
            size += n + 4096
        return parts

    def rows(self, part: Files):
        system, at = self.system()
        for pos, name in part.files:
            with system.open_input_stream(f"{at.rstrip('/')}/{name}") as f:
                yield pos, name, f.read()


class CorpusReader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder, self.tests = folder, []

    def _wanted(self, name: str) -> bool:
        test = {"EqualTo": lambda v: name == v, "In": lambda v: name in v, "StringStartsWith": lambda v: name.startswith(v)}
        return all(test[kind](value) for kind, value in self.tests)

    def partitions(self):
        numbered = [(i, name, size) for i, (name, size, _) in enumerate(self.folder.listed())]
        return self.folder.planned([f for f in numbered if self._wanted(f[1])])

    def read(self, partition):
        return self.folder.rows(partition)


class FilteringReader(CorpusReader):
    """With filters: Spark refuses readers that take filters where the session doesn't push them."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("file_name",):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f


class CorpusStream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self):
        return {"changed": -1}

    def latestOffset(self):
        return {"changed": max((t for _, _, t in self.folder.listed()), default=-1)}

    def partitions(self, start, end):
        return self.folder.planned([(None, name, size) for name, size, t in self.folder.listed() if start["changed"] < t <= end["changed"]])

    def read(self, partition):
        return self.folder.rows(partition)


class CorpusSource(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if self.options.get("filters") == "true" else CorpusReader)(_Folder(self.options))

    def streamReader(self, schema):
        return CorpusStream(_Folder(self.options))


def cleaned(files: DataFrame) -> DataFrame:
    return files.select("corpus_pos", "file_name", clean_content(F.col("raw")).alias("content"))


def load(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    """The rows of load_corpus."""
    spark.dataSource.register(CorpusSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return cleaned(spark.read.format("corpus").option("filters", filters).option("path", path).option("extension", extension).load())


def stream(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    spark.dataSource.register(CorpusSource)
    return cleaned(spark.readStream.format("corpus").option("path", path).option("extension", extension).load())
