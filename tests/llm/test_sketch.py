import hashlib

import pytest
from pyspark.sql import functions as F

from skein.llm import sketch


def shingles(t):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]
    return {" ".join(w)} - {""} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op4(spark, docs, store, monkeypatch):
    monkeypatch.setattr(sketch, "CHARS_PER_RANGE", 3000)
    rows = sketch.op4_sketch(spark, store(documents=docs.where("doc_id is null or doc_id <> 3"))).collect()
    own = sorted([(r.doc_id is not None, r.doc_id, r.text or "") for r in docs.where("doc_id is null or doc_id <> 3").collect()], key=lambda r: (r[0], r[1] or 0))
    assert len(rows) == len(own)
    got = {r.doc_id: r for r in rows}
    prints: dict = {}
    for i, (_, doc, t) in enumerate(own):
        nxt = own[(i + 1) % len(own)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[doc]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(t, edited), abs=0.17)
        assert r.near_next == pytest.approx(likeness(t, nxt), abs=0.17)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        if len(shingles(t)) < sketch.K:
            assert r.shingles == len(shingles(t))


def test_merge_and_estimates(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[sketch.sketch(F.col(c)).alias(c) for c in "ab"])
    r = df.select(sketch.resemblance(F.col("a"), F.col("b")), sketch.containment(F.col("a"), F.col("b")), sketch.distinct_shingles(F.col("a"))).first()
    assert r[0] == pytest.approx(1 / 3, abs=0.13) and r[1] == pytest.approx(0.5, abs=0.17) and r[2] == pytest.approx(2996, rel=0.3)
    parts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(k, k + 604))) for k in range(0, 3000, 600)], "g int, t string")
    parts = parts.select("g", sketch.sketch(F.col("t")).alias("s"))
    whole = spark.createDataFrame([(" ".join(f"w{i}" for i in range(3004)),)], "t string").select(sketch.sketch(F.col("t"))).first()[0]
    assert sketch.merge_parts(parts, ["g"], "s").first()["s"] == whole


def test_native(spark, docs, store):
    plan = sketch.op4_sketch(spark, store(documents=docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty(spark, empty, store):
    assert sketch.op4_sketch(spark, store(documents=empty)).count() == 0
