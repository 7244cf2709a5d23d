import random
import re

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    passage = prose(70)
    for i in range(400):
        bad = i % 5 == 0
        text = prose(40) + (" rottenword " if bad else " ") + prose(40)
        if i % 50 == 7:
            text = prose(30) + " " + passage + " " + prose(30)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bad)))
    rows += [(400 + i, rows[1][1], "en", "s0", 0) for i in range(5)] + [(500, None, None, None, None)]
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, passage


def test_stages(spark, folder, tmp_path):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mixing", "packing"]
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        at[name] = docs.collect()
        assert name == "packing" or docs.columns == COLUMNS
    assert {r.doc_id for r in at["toxicity"]} == {i for i, t, *_ in rows if "rottenword" not in (t or "")}
    kept = {r.doc_id for r in at["near_copies"]}
    assert kept == {r.doc_id for r in at["toxicity"]} - set(range(400, 405))
    assert {r.doc_id for r in at["repeats"]} == kept and sum(passage in (r.text or "") for r in at["repeats"]) == 1
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = sum(size(r.text) for r in at["repeats"]), sum(size(r.text) for r in at["mixing"])
    assert after == pytest.approx(before, abs=4)
    assert {r.doc_id for r in at["packing"]} == {r.doc_id for r in at["mixing"]}


def test_odd_tables(spark, folder, tmp_path, docs, empty):
    """Every stage on an empty table, and on one with nulls, blanks, a long text, repeated rows and clashing names."""
    for n, own in enumerate((empty, docs)):
        before = own.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, own, folder[0]).write.parquet(f"file://{tmp_path}/{n}-{name}")
            own = spark.read.parquet(f"file://{tmp_path}/{n}-{name}")
            assert name == "packing" or own.columns == before
            assert (own.count() > 0) == (n == 1)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "sequence_id", "offset", "length"}
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__
    from skein.llm import registry

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(registry.queries()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
