import random

import numpy as np
import pytest

from skein.llm import simhash


def fingerprint(t, n=3):
    import re

    import xxhash

    words = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    sh = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


@pytest.mark.parametrize("n", [1, 3, 5])
def test_fingerprint_by_the_rule(n):
    rng = random.Random(n)
    texts = ["", "", "  ", "One", "one TWO", "a b c", "A b\tc d\x0be f g g g g", " ÄÖ é x y z ", "", "x" * 300 + " y", "a " * 700, "\n"]
    texts += ["".join(rng.choice("aBcé \n🙂") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [" ".join("w" * rng.randint(1, 40) for _ in range(rng.randint(0, 900))) for _ in range(20)]
    raw = [t.encode() for t in texts]
    begin = np.cumsum([0] + [len(r) for r in raw])
    got = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), begin, n)
    assert got.tolist() == [fingerprint(t, n) for t in texts]


def test_hashes_by_the_library():
    import xxhash

    from skein.llm import xxh64

    data = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    start, length = map(np.array, zip(*[(s, n) for s in range(0, 300, 7) for n in range(0, 180, 3)]))
    got = xxh64.hashes(xxh64.padded(data), start, length, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(start, length)]


def components(ids, fps, radius=3):
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_op9(spark, docs, store):
    rows = simhash.op9_simhash(spark, store(documents=docs)).collect()
    own = sorted([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert len(rows) == docs.count()
    want = components([d for d, _ in own], [fingerprint(t) for _, t in own])
    text = dict(own)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fingerprint(text[r.doc_id]):016x}" and r.component_id == want[r.doc_id]


def test_all_links_are_found(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = {0, *base}
    for b in base:
        for r in range(1, 5):
            x = b
            for k in rng.sample(range(64), r):
                x ^= 1 << k
            fps.add(x)
    fps |= {(0xABCD << 48) | rng.getrandbits(48) for _ in range(200)}  # one very common part
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    for m in (2, 3, 4):
        monkeypatch.setattr(simhash, "partitions_for", lambda n, radius=3, m=m: m)
        got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(df, len(fps)).distinct().collect()}
        assert got == want


def test_thresholds_keep_the_principle():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(1 << 62), 1 << 62, 500)
    index = simhash.Index(sample, 10**9)
    t = index.thresholds(sample.view(np.uint64))
    assert (t.sum(axis=1) == simhash.RADIUS - index.m + 1).all() and (t >= -1).all()


def test_partitions_grow_wider_with_the_table():
    assert simhash.partitions_for(1000) == 4 and simhash.partitions_for(10**12) == 2


def test_deduplicate(docs):
    out = simhash.deduplicate(docs).collect()
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted({c for d, c in near.items() if d is not None})
    assert simhash.deduplicate(docs).columns == docs.columns and any(r.doc_id is None for r in out)


def test_chain_is_one_component(spark):
    from skein.llm.components import components as linked

    rng = random.Random(3)
    names = rng.sample(range(10**6), 300)
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[160], n) for n in names[161:]] + [(5, 5)]
    got = {r.node: r.root for r in linked(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in names[:151]} == {min(names[:151])} and {got[n] for n in names[160:]} == {min(names[160:])} and 5 not in got


def test_empty(spark, empty, store):
    assert simhash.op9_simhash(spark, store(documents=empty)).count() == 0
    assert simhash.deduplicate(empty).count() == 0
    pytest.importorskip("xxhash")
