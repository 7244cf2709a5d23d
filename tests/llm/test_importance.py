import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import importance


def features(text, n=2):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(d, *features(t)) for d, t in rows]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[0])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for d, fs, n in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_same_as_brute_force(spark, docs, texts, store):
    target = [texts[3], texts[7], "Some Other words", None, ""]
    sf = store(documents=docs, benchmark=spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    rows = importance.op11_importance(spark, sf).collect()
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], target)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows), key=repr)
    assert got == want
    assert sum(r.rank is not None for r in rows) > 5


def test_slices_change_nothing(docs):
    one, many = (sorted((r.bucket, r.n) for r in importance.counts(importance.streams(docs, slice_features=n)).collect()) for n in (1 << 20, 50))
    assert one == many
    written = importance.streams(docs, slice_features=50)
    assert written.count() > 20
    gain = list(range(10_000))
    rows = importance.gather(written, gain).select("__row.doc_id", "__row.__n", "__n", "__weight").collect()
    assert len(rows) == docs.count()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_change_nothing(n):
    rng = random.Random(n)
    for _ in range(200):
        text = "".join(rng.choice("ab é\n.Z9") for _ in range(rng.randint(0, 60)))
        want = Counter(zlib.crc32(f.encode()) % 997 for f in features(text, n)[0])
        for size in (1, 3, 7, 1000):
            got, words = importance.document_buckets(text.encode(), 997, n, size)
            assert Counter(got.tolist()) == want and words == features(text)[1]


def test_runs_and_empty_parts():
    assert [x.tolist() for x in importance.runs(np.array([0, 0, 3, 9, 9, 9], "<u2"))] == [[0, 3, 9], [2, 1, 3]]
    assert [x.tolist() for x in importance.runs(np.zeros(0, "<u2"))] == [[], []]
    w = importance.document_weights(np.array([1, 2, 2], "<u2"), np.array([0, 2, 2, 3, 3]), np.array([0, -5, 2]))
    assert w.tolist() == [0, -2, 0, 2, 0]


def test_further_columns_are_kept(docs):
    out = importance.resample(docs, docs.limit(3))
    assert out.count() == docs.count()
    a, b = (sorted(map(str, x)) for x in (out.select("__row.doc_id", "__row.score", "__row.__n").collect(), docs.select("doc_id", "score", "__n").collect()))
    assert a == b


def test_empty_tables(spark, docs, empty):
    assert importance.resample(empty, docs).count() == 0
    assert importance.resample(docs, empty).where(F.col("__rank").isNotNull()).count() > 0


def test_drawn_like_the_target(spark):
    rng = random.Random(1)
    words = {k: [f"{k}{i}" for i in range(200)] for k in "ab"}
    rows = [(i, " ".join(rng.choices(words["a" if i % 4 == 0 else "b"], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(words["a"], k=60)),) for _ in range(50)], "text string")
    drawn = [r["__id"] for r in importance.resample(docs, target).where("__rank is not null").collect()]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 60
