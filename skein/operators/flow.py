"""Maximum flow on many small graphs: one graph per group, augmented along shortest paths.

Graphs are independent rows of one edge table, so a batch of them is spread over the cluster by graph_id; a single
graph is solved in one task (it is iterative and must be in one place).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import materialize

EDGES = "graph_id, edge_pos, src, dst, capacity"


class Network:
    """Residual capacities; edge i and its reverse i ^ 1 are neighbours in one list."""

    def __init__(self, edges):
        self.to: list[int] = []
        self.left: list[int] = []
        self.out: dict[int, list[int]] = {}
        for src, dst, capacity in edges:
            if capacity < 0:
                raise ValueError(f"capacity of {src} -> {dst} is negative: {capacity}")
            for u, v, c in ((src, dst, capacity), (dst, src, 0)):
                self.out.setdefault(u, []).append(len(self.to))
                self.to.append(v)
                self.left.append(c)

    def shortest_path(self, source: int, sink: int) -> list[int]:
        """The edges of a shortest path with room, [] without one."""
        came = {source: -1}
        queue = deque([source])
        while queue and sink not in came:
            for e in self.out.get(queue[0], ()):
                if self.left[e] > 0 and self.to[e] not in came:
                    came[self.to[e]] = e
                    queue.append(self.to[e])
            queue.popleft()
        path, at = [], sink
        while came.get(at, -1) >= 0:
            path.append(came[at])
            at = self.to[came[at] ^ 1]
        return path[::-1]

    def run(self, source: int, sink: int) -> list[tuple[list[int], int]]:
        """Augmenting paths in order, as vertices, and what each adds."""
        if source == sink:
            raise ValueError("source and sink must differ")
        found = []
        while path := self.shortest_path(source, sink):
            room = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= room
                self.left[e ^ 1] += room
            found.append(([source, *(self.to[e] for e in path)], room))
        return found


def _per_graph(edges: DataFrame, terminals: DataFrame, solve, schema: str) -> DataFrame:
    checked = edges.withColumn("capacity", F.when(F.col("capacity") < 0, F.raise_error(F.lit("negative capacity")).cast("int")).otherwise(F.col("capacity")))

    def one(key: tuple, own: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("edge_pos", kind="stable")
        rows = []
        for source, sink in zip(ends["source"], ends["sink"]):
            paths = Network(zip(own["src"].tolist(), own["dst"].tolist(), own["capacity"].tolist())).run(int(source), int(sink))
            rows += solve(key[0], paths)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    ends = terminals.select(F.col("graph_id").alias("ends_of"), "source", "sink")  # another name, as it may derive from the edges
    return checked.groupBy("graph_id").cogroup(ends.groupBy("ends_of")).applyInPandas(one, schema)


def max_flow(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """edges: graph_id, edge_pos, src, dst, capacity; terminals: graph_id, source, sink -> graph_id, max_flow."""
    return _per_graph(edges, terminals, lambda g, paths: [(g, sum(r for _, r in paths))], "graph_id string, max_flow long")


def augmenting_paths(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """graph_id, path_no, path (vertices), flow."""
    return _per_graph(edges, terminals, lambda g, paths: [(g, i + 1, p, r) for i, (p, r) in enumerate(paths)], "graph_id string, path_no int, path array<long>, flow long")


def network_edges(candidates: DataFrame, max_total: int, per_category: int, per_brand: int) -> DataFrame:
    """The selection network of each query's candidates (query_id, rank, category_key, brand_key) as an edge table.

    Vertices: 0 source, 1 all, then categories, brands and the sink, numbered by key within the query.
    """
    from pyspark.sql import Window as W

    q = W.partitionBy("query_id")
    c = materialize(candidates, "candidates").withColumn("c", F.dense_rank().over(q.orderBy("category_key"))).withColumn("b", F.dense_rank().over(q.orderBy("brand_key")))
    c = c.withColumn("nc", F.max("c").over(q)).withColumn("nb", F.max("b").over(q))
    one = F.lit(1).cast("long")
    cat, brand = F.col("c") + 1, F.col("nc") + F.col("b") + 1
    sink = F.col("nc") + F.col("nb") + 2
    head = c.groupBy("query_id").agg(F.lit(0).alias("src"), F.lit(1).alias("dst"), F.lit(max_total).cast("long").alias("capacity"))
    to_cat = c.groupBy("query_id", cat.alias("dst")).agg(F.least(F.lit(per_category), F.count(F.lit(1))).alias("capacity")).select("query_id", F.lit(1).alias("src"), "dst", "capacity")
    middle = c.select("query_id", cat.alias("src"), brand.alias("dst"), one.alias("capacity"))
    out = c.groupBy("query_id", brand.alias("src"), sink.alias("dst")).agg(F.least(F.lit(per_brand), F.count(F.lit(1))).alias("capacity"))
    every = head
    for part in (to_cat, middle, out):
        every = every.unionByName(part)
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("src", "dst"))
    return every.select(F.col("query_id").cast("string").alias("graph_id"), pos.alias("edge_pos"), "src", "dst", "capacity")
