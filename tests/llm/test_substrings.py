import hashlib
import random

import numpy as np
import pytest

from skein.llm import substrings
from skein.llm.suffix_array import common_prefixes, suffix_array


def brute(own, length=100):
    seen: set = set()
    out = {}
    for d, t in own:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def test_op10(spark, docs, store):
    own = docs.where("doc_id is not null and doc_id <> 3")
    rows = substrings.op10_substrings(spark, store(documents=own)).collect()
    want = brute(sorted((r.doc_id, r.text) for r in own.collect()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 10_000


@pytest.mark.parametrize("split, shard_bytes", [(3, 3000), (1, 700)])
def test_split_anchors_are_merged(docs, split, shard_bytes):
    own = docs.where("doc_id is not null and doc_id <> 3").select("doc_id", "text")
    found = {r.doc_id: r.spans for r in substrings.repeated_spans(own, split=split, shard_bytes=shard_bytes).collect()}
    want = brute(sorted((r.doc_id, r.text) for r in own.collect()))
    for r in own.collect():
        kept, removed, runs = substrings.cut((r.text or "").encode(), found.get(r.doc_id))
        assert (removed, runs, hashlib.sha256(kept).hexdigest()) == want[r.doc_id][1:]


def test_rows_of_one_id(spark):
    rng = random.Random(1)
    t, u = ("".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(2))
    for parts in (1, 5):
        df = spark.createDataFrame([(1, t), (1, t), (1, u), (None, t[:150]), (2, t), (3, u), (3, u)], "doc_id long, text string").repartition(parts)
        rows = {(d, n, x) for d, n, x in run(df)}
        # t's first 150 bytes lie with the null id; its rows under id 1 don't remove each other, nor those of u under 3
        assert rows == {(None, 150, 0), (1, 400, 150), (1, 400, 0), (2, 400, 400), (3, 400, 400)}


def run(df):
    found = {(r.doc_id, r.crc): r.spans for r in substrings.repeated_spans(df).collect()}
    import zlib

    out = []
    for r in df.collect():
        b = r.text.encode()
        key = (-(1 << 63) if r.doc_id is None else r.doc_id, zlib.crc32(b))
        out.append((r.doc_id, len(b), substrings.cut(b, found.get(key))[1]))
    return out


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(400):
        t = bytes(rng.choice([0, 97, 98, 255][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60)))
        t += t[: rng.randint(0, len(t))] * rng.randint(0, 2)
        a = np.frombuffer(t, np.uint8)
        sa, rank = suffix_array(a)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = common_prefixes(a, sa, rank)
        for i in range(1, len(t)):
            x, y = t[sa[i - 1] :], t[sa[i] :]
            assert lcp[i] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_every_window_has_one_owner():
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab c") for _ in range(600)) + b"x" * 200
    at, h, first, last = substrings.anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    assert ((at >= first) & (at + substrings.K <= first + 100 + (last - first))).all() and (last - first < 100 - substrings.K + 1).all()


def test_remove_repeats(docs, empty):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert sum(len(r.text or "") for r in rows) < sum(len(r.text or "") for r in docs.collect())
    assert substrings.remove_repeats(empty).count() == 0


def test_empty(spark, empty, store):
    assert substrings.op10_substrings(spark, store(documents=empty)).count() == 0


def test_runs_grow_as_contexts_do(spark, monkeypatch):
    """A passage in many texts: its edges' anchors are split, and twice the texts make no more than about twice the runs."""
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, found, runs = prose(140), {}, []
    texts = [prose(150) + passage + prose(rng.randint(100, 200)) for _ in range(160)]
    whole = substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df, name: found.setdefault(f"{name} {len(found)}", whole(df, name)))
    for n in (80, 160):
        found.clear()
        own = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        spans = {r.doc_id: r.spans for r in substrings.repeated_spans(own, split=10, shard_bytes=2000).collect()}
        want = brute(enumerate(texts[:n]))
        assert {d: substrings.cut(t.encode(), spans.get(d))[1:] for d, t in enumerate(texts[:n])} == {d: v[1:3] for d, v in want.items()}
        local = next(df for name, df in found.items() if name.startswith("shard-spans"))
        runs.append(local.where("kind = 1").count())
    assert 0 < runs[0] and runs[1] <= 3 * runs[0]
