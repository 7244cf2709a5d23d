import zlib
from collections import defaultdict

import pytest

from skein.llm import sharding


def test_op8(spark, docs, store):
    rows = sharding.op8_sharding(spark, store(documents=docs)).collect()
    own = docs.select("doc_id", "text").collect()
    text = {r.doc_id: r.text or "" for r in own}
    assert len(rows) == len(own) and {r.law for r in rows} == {"bytes"}
    shards, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        data = text[r.doc_id].encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.grown_shard is None and 0 <= r.shard < 8
        shards[r.shard].append(r)
        by_text[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_balance(spark, shards):
    import random

    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60)))) for i in range(3000)]
    rows += [(3000 + i, "the same text") for i in range(300)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards, rows_per_bucket=50).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["__shard"]] += r["__weight"]
    assert len(sizes) == shards and max(sizes.values()) < 1.05 * min(sizes.values())


def brute(points, leaves, target):
    """A weighted median tree over (dims..., hash, weight): the leaf number of each point, left to right."""
    whole = [max(1, max(p[d] for p in points) - min(p[d] for p in points)) for d in range(4)]
    out, numbers = {}, iter(range(10**6))

    def place(own, leaves, first):
        weight = sum(p[5] for p in own)
        if leaves == 1 or (target and (weight <= target or len({p[4] for p in own}) == 1)) or not own:
            n = next(numbers) if target else first
            for p in own:
                out[p] = n
            return
        share = [(max(p[d] for p in own) - min(p[d] for p in own)) / whole[d] for d in range(4)]
        d = share.index(max(share))
        goal = weight / 2 if leaves is None else weight * (leaves // 2) / leaves
        below = 0
        for x in sorted({(p[d], p[4]) for p in own}):
            w = sum(p[5] for p in own if (p[d], p[4]) == x)
            if below + w >= goal:
                with_it = below + w - goal <= goal - below
                break
            below += w
        left = [p for p in own if (p[d], p[4]) < x or ((p[d], p[4]) == x and with_it)]
        right = [p for p in own if p not in set(left)]
        half = None if leaves is None else leaves // 2
        place(left, half, first)
        place(right, None if half is None else leaves - half, first + (half or 0))

    place(points, leaves, 0)
    return out


@pytest.mark.parametrize("leaves, target", [(8, None), (5, None), (None, 3000)])
def test_tree_by_brute_force(spark, docs, leaves, target):
    from pyspark.sql import functions as F

    rows = sharding.shard(docs, leaves, target, rows_per_bucket=10).collect()
    names = [f"__{n}" for n in sharding.DIMS]
    weights: dict = defaultdict(int)
    for r in rows:
        weights[tuple(r[n] for n in names) + (r["__h"],)] += r["__weight"]
    want = brute([(*k, w) for k, w in weights.items()], leaves, target)
    want = {k[:5]: v for k, v in want.items()}
    assert all(r["__shard"] == want[tuple(r[n] for n in names) + (r["__h"],)] for r in rows)
    if target:
        sizes: dict = defaultdict(list)
        for r in rows:
            sizes[r["__shard"]].append(r)
        assert all(sum(x["__weight"] for x in s) <= target or len({x["__h"] for x in s}) == 1 for s in sizes.values())
    assert {r["__crc"] for r in rows} == {r[0] for r in docs.select(F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).collect()}


def test_large_group_stays_whole(spark):
    rows = [(i, "copy copy copy") for i in range(600)] + [(600 + i, f"text {i} {'x' * (i % 50)}") for i in range(1200)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8, rows_per_bucket=100).collect()
    assert len({r["__shard"] for r in out if r.doc_id < 600}) == 1 and len(out) == 1800


def test_empty(spark, empty, store):
    assert sharding.op8_sharding(spark, store(documents=empty)).count() == 0
