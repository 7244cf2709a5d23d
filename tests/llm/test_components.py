import random

from skein.llm.components import components


def test_odd_links(spark):
    rows = components(spark.createDataFrame([(1, 1), (2, 3), (3, 2), (3, 2), (None, 4), (5, None)], "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in rows) == [(2, 2), (3, 2)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_same_as_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
