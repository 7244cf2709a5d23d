import random
from itertools import combinations

import pytest

from skein.operators import chains, flow, recommend

SCHEMA = "query_id int, rank int, product_name string, category string, brand string, score int"


def selection_flow(rows, max_total, per_category, per_brand):
    """How many of (category, brand) fit under three limits, by a flow."""
    edges = [("s", "all", max_total)] + [("all", ("c", c), per_category) for c in {c for c, _ in rows}]
    edges += [(("c", c), ("b", b), 1) for c, b in rows] + [(("b", b), "t", per_brand) for b in {b for _, b in rows}]
    return sum(r for _, r in flow.Network(edges).run("s", "t"))


def best_choice(rows, max_total, per_category, per_brand):
    """The size, and the places that stay when the worst go first, as far as the size can spare them."""
    size, kept = selection_flow(rows, max_total, per_category, per_brand), list(range(len(rows)))
    for i in reversed(range(len(rows))):
        rest = [k for k in kept if k != i]
        if selection_flow([rows[k] for k in rest], max_total, per_category, per_brand) == size:
            kept = rest
    return size, kept


def decided_by_flows(rows, max_total, tiers):
    every = [best_choice(rows, max_total, *t) for t in tiers]
    target = min(max_total, len(rows))
    tier = next((i for i, (n, _) in enumerate(every) if n >= target), max(range(len(tiers)), key=lambda i: (every[i][0], -i)))
    return [(tier + 1, i in every[tier][1], every[tier][0]) for i in range(len(rows))]


def as_rows(own):
    pools = {}
    for r in own.orderBy("query_id", "place").collect():
        pools.setdefault(r.query_id, []).append((r.category_key, r.brand_key))
    return pools


def held_against_flows(own, got, max_total, tiers):
    found = {}
    for r in got.orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.tier, r.selected, r.max_flow))
    assert found == {q: decided_by_flows(rows, max_total, tiers) for q, rows in as_rows(own).items()}


def test_chains_equal_flows(spark):
    rng = random.Random(11)
    rows = [(q, r + 1, f"p{r}", rng.choice("ABCDE"[: 1 + q % 5]), rng.choice("VWXYZ"[: 1 + q // 5 % 5]), 1) for q in range(75) for r in range(rng.randint(1, 14))]
    own = recommend.candidates(spark.createDataFrame(rows, SCHEMA)).persist()
    for max_total, tiers in ((6, ((2, 2), (6, 6))), (5, ((1, 1), (1, 2), (2, 1))), (3, ((2, 3), (0, 3)))):
        held_against_flows(own, recommend._by_chains(own, max_total, tiers), max_total, tiers)


def test_chains_on_long_lists(spark):
    """More places than a long has bits, and pools that are cut before; limits of nothing; no rows."""
    rng = random.Random(3)
    pools = [[(f"c{i // 40}", f"b{i % 40 if i < 40 else 0}") for i in range(150)], [(f"c{min(i // 30, 9)}", f"b{i % 2}" if i < 140 else f"b{i}") for i in range(180)]]
    pools += [[(f"c{rng.randint(0, 3)}", f"b{rng.randint(0, 3)}") for _ in range(120)]]
    own = spark.createDataFrame([(q, i, c, b) for q, pool in enumerate(pools) for i, (c, b) in enumerate(pool)], "query_id int, place int, category_key string, brand_key string")
    for limits in ((4, 1, 1), (6, 2, 1), (6, 1, 3)):
        got = {}
        for r in chains.choose(own, *limits).collect():
            got.setdefault(r.query_id, []).append(r.place)
        assert {q: sorted(p) for q, p in got.items()} == {q: best_choice(pool, *limits)[1] for q, pool in enumerate(pools)}
    assert chains.choose(own, 6, 0, 2).count() == 0 and chains.choose(own.limit(0), 6, 2, 2).count() == 0


def test_windows_equal_flows(spark):
    rng = random.Random(42)
    rows = []
    for q in range(60):
        for r in range(rng.randint(1, 20)):
            rows.append((q, r + 1, f"p{rng.randint(0, 30)}", rng.choice(["A", "a", "B", None, ""]), rng.choice(["X", "x", "Y", "Z", None, " "]), rng.choice([None, 5])))
    own = recommend.candidates(spark.createDataFrame(rows, SCHEMA))
    held_against_flows(own, recommend._by_windows(own, 6, recommend.TIERS), 6, recommend.TIERS)


def test_both_limits_give_the_largest_choice(spark):
    rng = random.Random(7)
    rows = [(q, r + 1, f"p{r}", rng.choice("ABC"), rng.choice("XYZ"), 1) for q in range(40) for r in range(rng.randint(1, 9))]
    got = recommend.decide(spark.createDataFrame(rows, SCHEMA), tiers=((2, 2),)).where("selected").collect()
    for q in range(40):
        own = [(c, b) for q2, _, _, c, b, _ in rows if q2 == q]
        fits = lambda s: all([x for x, _ in s].count(k) <= 2 for k in "ABC") and all([y for _, y in s].count(k) <= 2 for k in "XYZ")
        best = max(n for n in range(0, min(6, len(own)) + 1) if any(fits(s) for s in combinations(own, n)))
        assert sum(r.query_id == q for r in got) == best


def test_cleaning(spark):
    rows = [(1, 1, "p0", None, None, None), (1, 2, "P0 ", "x", "y", 1), (1, 3, "p1", "", " ", 2), (1, 4, None, "x", "y", 3), (1, 5, "  ", "x", "y", 3), (2, 1, " ", "x", "y", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    d = recommend.decide(df)
    got = recommend.selected(d).orderBy("slot").collect()
    assert [(r.product_name, r.category, r.brand, r.score) for r in got] == [("p0", "Other Products", "-", "-"), ("p1", "Other Products", "-", "2")]
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    notes = {r.query_id: r.note for r in recommend.status(queries, df, d).collect()}
    assert notes == {1: "ok", 2: "No valid products available.", 3: "No products available for recommendation."}


def test_single_brand_moves_to_the_second_tier(spark):
    df = spark.createDataFrame([(1, i + 1, f"p{i}", f"c{i % 5}", "Apple", 9) for i in range(10)], SCHEMA)
    d = recommend.decide(df).persist()
    assert d.where("selected").count() == 6 and d.first().tier == 2
    assert all(r.ok for r in recommend.constraints(d).collect())
    assert recommend.rejected(d).first().reason == "all 6 recommendation slots already used"


def graph(spark, name, edges, source, sink):
    e = spark.createDataFrame([(name, i, *x) for i, x in enumerate(edges)], "graph_id string, edge_pos int, src int, dst int, capacity int")
    return e, spark.createDataFrame([(name, source, sink)], "graph_id string, source int, sink int")


CLRS = [(0, 1, 16), (0, 2, 13), (1, 2, 10), (2, 1, 4), (1, 3, 12), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)]


@pytest.mark.parametrize("edges, sink, flow_", [(CLRS, 5, 23), ([(0, 1, 5)], 2, 0), ([(0, 1, 3), (0, 1, 4)], 1, 7), ([(0, 1, 0)], 1, 0), ([(0, 1, 100), (1, 2, 1), (2, 3, 100)], 3, 1), ([(0, 1, 1), (0, 2, 1), (1, 2, 1), (1, 3, 1), (2, 3, 1)], 3, 2)])
def test_flows(edges, sink, flow_):
    assert sum(r for _, r in flow.Network(edges).run(0, sink)) == flow_


def test_random_flows_equal_least_cuts():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(2, 7)
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 8)) for _ in range(rng.randint(0, 14))]
        cut = min(sum(c for u, v, c in edges if s >> u & 1 and not s >> v & 1) for s in range(1 << n) if s & 1 and not s >> (n - 1) & 1)
        assert sum(r for _, r in flow.Network(edges).run(0, n - 1)) == cut


def test_flow_tables(spark):
    e, t = graph(spark, "clrs", CLRS, 0, 5)
    assert flow.max_flow(e, t).collect() == [("clrs", 23)]
    paths = flow.augmenting_paths(e, t).collect()
    assert sum(r.flow for r in paths) == 23 and all(r.path[0] == 0 and r.path[-1] == 5 for r in paths)
    bad, t = graph(spark, "bad", [(0, 1, -1)], 0, 1)
    with pytest.raises(Exception, match="negative"):
        flow.max_flow(bad, t).collect()
    with pytest.raises(ValueError):
        flow.Network([(0, 1, 1)]).run(0, 0)
