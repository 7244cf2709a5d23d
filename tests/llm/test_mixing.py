import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule itself: cap, share the rest anew, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: float(most * sizes[s]) if s in capped else level[s] for s in names}
        capped |= set(over)


def test_mix(spark, docs, store):
    sf = store(documents=docs)
    rows = mixing.op1_mixing(spark, sf).collect()
    assert sorted(rows, key=str) == sorted(mixing.op1_mixing(spark, sf).collect(), key=str)
    own = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in own:
        sizes[r.source] += size(r.text)
    want = targets(sizes)
    source = {r.doc_id: r.source for r in own}
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r.doc_id or -1, size(r.text)) for r in own)
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)


def test_small_buckets_change_nothing(docs):
    sized = docs.withColumn("__size", mixing.word_count(F.col("text"))).withColumn("__key", mixing.order_key(F.col("doc_id"), F.col("text")))
    a, b = (mixing.assign(sized, rows_per_bucket=n).select("doc_id", "__taken", "__position").collect() for n in (3, 10_000))
    assert sorted(a, key=str) == sorted(b, key=str)


def test_mixed_rows(docs):
    out = mixing.mix(docs).select("doc_id", "text", "source").collect()
    words = defaultdict(int)
    for r in out:
        words[r.source] += size(r.text)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    assert dict(words) == {s: int(t + 1e-6) for s, t in targets(sizes).items() if int(t + 1e-6)}
    assert mixing.mix(docs).columns == docs.columns


def test_schedule_inverse(spark):
    knots = mixing.COURSES[2]
    df = spark.range(101).select((F.col("id") / 100.0).alias("s"))
    for r in df.select("s", mixing.time_of(F.col("s"), knots).alias("t")).collect():
        done, (t0, w0) = 0.0, knots[0]
        for t1, w1 in knots[1:]:
            x = min(max(r.t - t0, 0), t1 - t0)
            done += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            t0, w0 = t1, w1
        assert done == pytest.approx(r.s, abs=1e-9)


def test_empty(spark, empty, store):
    assert mixing.op1_mixing(spark, store(documents=empty)).count() == 0
    assert mixing.mix(empty).count() == 0


def test_position_is_progress(spark):
    """Of all words taken, as many lie before a take as its position says; null ids are told apart."""
    rows = [(None if i % 50 == 0 else i, f"w{i} " * (i % 40 + 1), f"s{i % 6}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.withColumn("__size", mixing.word_count(F.col("text"))).withColumn("__key", mixing.order_key(F.col("doc_id"), F.col("text")))
    takes = mixing.assign(sized).select(F.explode("__takes").alias("t")).select("t.words", "t.position").collect()
    total, done = sum(t.words for t in takes), 0
    for t in sorted(takes, key=lambda t: t.position):
        assert abs(done / total - t.position) < 0.01
        done += t.words
    assert sized.where("doc_id is null").select("__key").distinct().count() == 60
