import random

import pytest

from skein.operators import flow, flow_rounds, spelling


def graphs(spark, rows):
    """rows: graph, source, sink, list of (src, dst, capacity)."""
    edges = [(g, i, *e) for g, _, _, es in rows for i, e in enumerate(es)]
    ends = [(g, s, t) for g, s, t, _ in rows]
    return (
        spark.createDataFrame(edges, "graph_id string, edge_pos int, src int, dst int, capacity int"),
        spark.createDataFrame(ends, "graph_id string, source int, sink int"),
    )


def found(df):
    return {r.graph_id: r.max_flow for r in df.collect()}


KNOWN = [
    ("two ways", 0, 3, [(0, 1, 5), (0, 2, 4), (1, 3, 3), (2, 3, 9), (1, 2, 1)], 8),
    ("apart", 0, 2, [(0, 1, 5)], 0),
    ("parallel", 0, 1, [(0, 1, 3), (0, 1, 4)], 7),
    ("none", 0, 1, [(0, 1, 0)], 0),
    ("narrow", 0, 3, [(0, 1, 100), (1, 2, 1), (2, 3, 100)], 1),
    ("undo", 0, 3, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (1, 3, 1), (2, 3, 1)], 2),
    ("loop", 0, 2, [(0, 0, 9), (0, 1, 4), (1, 1, 9), (1, 0, 9), (1, 2, 3)], 3),
    ("same ends", 0, 0, [(0, 1, 4)], 0),
    ("back", 0, 3, [(0, 1, 10), (1, 2, 10), (2, 1, 5), (2, 3, 4), (1, 4, 10), (4, 5, 10), (5, 3, 5)], 9),
]


def test_known_flows(spark):
    edges, ends = graphs(spark, [k[:4] for k in KNOWN])
    assert found(flow_rounds.max_flow(edges, ends)) == {k[0]: k[4] for k in KNOWN}


def test_random_graphs_and_their_cuts(spark, monkeypatch):
    monkeypatch.setattr(flow_rounds, "SLOTS", 2)
    monkeypatch.setattr(flow_rounds, "ROUNDS_A_WRITE", 2)
    rng = random.Random(11)
    rows = []
    for k in range(25):
        n = rng.randint(2, 9)
        rows.append((f"g{k}", 0, n - 1, [(rng.randrange(n), rng.randrange(n), rng.randint(0, 8)) for _ in range(rng.randint(1, 26))]))
    edges, ends = graphs(spark, rows)
    flows, _, reach = flow_rounds.solve(edges, ends)
    got = found(flows)
    assert got == found(flow.max_flow(edges, ends))
    # The edges that lead into what reaches the sink are as much as the flow.
    side = {(r.graph_id, r.u) for r in reach.collect()}
    for g, _, _, es in rows:
        assert got[g] == sum(c for u, v, c in es if (g, u) not in side and (g, v) in side)


def test_one_vertex_with_many_edges(spark):
    n = 3000
    es = [(0, 1, 5000)] + [(1, 2 + i, 1 + i % 3) for i in range(n)] + [(2 + i, n + 2, 2) for i in range(n)]
    edges, ends = graphs(spark, [("hub", 0, n + 2, es)])
    assert found(flow_rounds.max_flow(edges, ends)) == {"hub": min(5000, sum(min(1 + i % 3, 2) for i in range(n)))}


def test_odd_tables(spark):
    edges, ends = graphs(spark, [("g", 0, 1, [(0, 1, 3)])])
    assert found(flow_rounds.max_flow(edges.limit(0), ends)) == {"g": 0}
    assert found(flow_rounds.max_flow(edges, ends.limit(0))) == {}
    assert found(flow_rounds.max_flow(edges.selectExpr("graph_id", "src", "dst", "cast(null as int) as capacity"), ends)) == {"g": 0}
    with pytest.raises(ValueError):
        flow_rounds.max_flow(edges.selectExpr("graph_id", "src", "dst", "-1 as capacity"), ends)


def test_many_vertices_are_shuffled(spark):
    """Tables of vertices have small files: the planner would broadcast them in every round."""
    rooms = spark.createDataFrame([("g", "a", "b", 3), ("g", "b", "t", 2)], "graph_id string, u string, v string, room long")
    held = spark.createDataFrame([("g", "a", 2)], "graph_id string, u string, excess long")
    far = spark.createDataFrame([("g", "a", 2), ("g", "b", 1), ("g", "t", 0)], "graph_id string, u string, far int")
    pushes = flow_rounds.pushes_of(rooms, held, far)
    assert "BroadcastHashJoin" not in pushes._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pushes.collect()] == [("g", "a", "b", 2)]


def test_same_flow_without_broadcasts(spark, monkeypatch):
    edges = spark.createDataFrame([("g", i, s, d, c) for i, (s, d, c) in enumerate([("s", "a", 3), ("s", "b", 2), ("a", "t", 2), ("a", "b", 2), ("b", "t", 3)])], "graph_id string, edge_pos int, src string, dst string, capacity long")
    ends = spark.createDataFrame([("g", "s", "t")], "graph_id string, source string, sink string")
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 0)
    assert flow_rounds.max_flow(edges, ends).first().max_flow == 5
