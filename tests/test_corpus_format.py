import pytest

from skein.sources import corpus, corpus_format


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for n in range(6):
        (at / f"p{n}.txt").write_text(f"text {n}\r\n" * n)
    (at / "B odd+.TXT").write_bytes(b"bad \xff\xf0\x80 bytes\xe2\x82\rend")
    (at / "notes.md").write_text("no")
    (at / "sub").mkdir()
    return at


def test_same_rows_as_load_corpus(spark, folder):
    assert sorted(corpus_format.load(spark, str(folder)).collect()) == sorted(corpus.load_corpus(spark, str(folder)).collect())


def test_partitions_and_filters(folder):
    own = corpus_format._Folder({"path": str(folder), "partitionbytes": "9000"})
    reader = corpus_format.FilteringReader(own)
    parts = reader.partitions()
    assert len(parts) > 1 and [f for p in parts for f in p.files] == [(i, f[0]) for i, f in enumerate(own.listed())]
    left = list(reader.pushFilters([corpus_format.StringStartsWith(("file_name",), "p"), corpus_format.EqualTo(("corpus_pos",), 3)]))
    assert len(left) == 1 and {n for p in reader.partitions() for _, n in p.files} == {f"p{n}.txt" for n in range(6)}


def test_filters_in_a_query(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = corpus_format.load(spark, str(folder)).where("file_name = 'p3.txt'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [(r.file_name, r.corpus_pos) for r in rows] == [("p3.txt", 4)]


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="no folder at"):
        corpus_format.load(spark, str(tmp_path / "nowhere")).collect()
    assert corpus_format.load(spark, str(tmp_path)).count() == 0


def test_stream(spark, folder, tmp_path):
    def go():
        q = corpus_format.stream(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.file_name for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = go()
    assert len(first) == 7
    (folder / "later.txt").write_text("later")
    assert go() == sorted([*first, "later.txt"])
