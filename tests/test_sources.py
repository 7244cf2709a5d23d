import io
import json
import os
from contextlib import redirect_stdout

import pytest

from skein.__main__ import loop
from skein.engine import Engine
from skein.sources import corpus
from skein.streaming import answers

TEXT = "Product Name: Zed Phone {n}\nBrand: Zed{n}\nCategory: Smartphone\nAverage Rating: 4.{n}/5\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    for n in range(8):
        (d / f"p{n}.txt").write_text(TEXT.format(n=n))
    (d / "A b+c.TXT").write_bytes(b"Product Name: Odd \xff name\r\nBrand: Q\r")
    (d / "empty.txt").write_bytes(b"")
    (d / "notes.md").write_text("no")
    (d / "sub").mkdir()
    (d / "sub" / "x.txt").write_text("no")
    return str(d)


def test_load(spark, folder):
    rows = corpus.load_corpus(spark, folder).orderBy("corpus_pos").collect()
    assert [r.file_name for r in rows] == ["A b+c.TXT", "empty.txt", *[f"p{n}.txt" for n in range(8)]]
    assert [r.corpus_pos for r in rows] == list(range(10))
    assert rows[0].content == "Product Name: Odd � name\nBrand: Q\n" and rows[1].content == ""


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        corpus.load_corpus(spark, str(tmp_path / "nowhere"))


def test_console(spark, folder):
    out = io.StringIO()
    with redirect_stdout(out):
        loop(Engine.open(spark, folder), ["zed phonne", "y", "", "!!", "/trie", "ze", "/time", "zed", "qqqq", "EXIT", "never"])
    said = out.getvalue()
    assert "phonne -> phone" in said and "All constraints satisfied." in said and "valid search query" in said
    assert "p0.txt" in said and "count     : " in said and "No similar products found." in said


def test_stream(spark, folder, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps({"query_id": i, "query_text": t}) for i, t in enumerate(["zed phone 3", "odd"])))
    stream = answers.answer_stream(Engine.open(spark, folder), answers.query_stream(spark, str(inbox)), out, str(tmp_path / "ck"))
    stream.processAllAvailable()
    stream.stop()
    rows = spark.read.parquet(out).where("rank = 1").collect()
    assert {r.query_id: r.product_name for r in rows} == {0: "Zed Phone 3", 1: "Odd � name"}
    assert os.listdir(out)
