"""Maximum flow of graphs of any size on a table of edges, in rounds of pushes.

Every vertex may hold an excess. First the source fills its edges. Then, in phases: distances to the sink over edges with room
are found level by level, and in rounds every vertex with an excess pushes it along edges that lead one step nearer, as far as
there is room; a round is one join of the edges with the vertices that have something to push. When no vertex with
an excess can reach the sink any more, what the sink holds is the maximum flow: the edges between vertices that reach the
sink and those that don't are full. All graphs of the table go through the same rounds.

A round writes its pushes; edges and excesses are the written ones plus the pushes since, and are written anew once a phase.
So lineage is short and an executor that is lost costs a round. A vertex with very many edges pushes along all of them in one
round: what comes before an edge is summed in two levels, over `SLOTS` parts of the vertex's edges and inside a part, so
no task holds all of them. Tables of vertices are broadcast only if they have few rows, which is counted; else they are
shuffled: their files are so small for their rows that the planner would broadcast them in every round.

Defined cases: parallel edges add up; loops and edges without capacity carry nothing; a negative capacity is an error; null
capacities are 0; a graph whose sink can't be reached, or is its source, has flow 0; graphs without ends are left out;
empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import materialize
from .spelling import Hint, batch_hint, shuffled

SLOTS = 64
#: Pushes of so many rounds are merged into the tables of a phase before it goes on.
ROUNDS_A_WRITE = 12


def residual(edges: DataFrame) -> DataFrame:
    """graph_id, u, v, room: both directions of every pair of vertices that an edge joins."""
    own = edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.coalesce("capacity", F.lit(0)).cast("long").alias("room")).where("u <> v")
    back = own.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).cast("long").alias("room"))
    return own.unionByName(back).groupBy("graph_id", "u", "v").agg(F.sum("room").alias("room"))


def _after(rooms: DataFrame, pushes: list[DataFrame]) -> DataFrame:
    """The edges' room after pushes (graph_id, u, v, push)."""
    if not pushes:
        return rooms
    every = _union(pushes)
    change = every.select("graph_id", "u", "v", (-F.col("push")).alias("room")).union(every.select("graph_id", F.col("v").alias("u"), F.col("u").alias("v"), F.col("push").alias("room")))
    return rooms.unionByName(change).groupBy("graph_id", "u", "v").agg(F.sum("room").alias("room"))


def _held(held: DataFrame, pushes: list[DataFrame]) -> DataFrame:
    """graph_id, u, excess after pushes."""
    if not pushes:
        return held
    every = _union(pushes)
    change = every.select("graph_id", "u", (-F.col("push")).alias("excess")).union(every.select("graph_id", F.col("v").alias("u"), F.col("push").alias("excess")))
    return held.unionByName(change).groupBy("graph_id", "u").agg(F.sum("excess").alias("excess"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def distances(rooms: DataFrame, ends: DataFrame) -> DataFrame:
    """graph_id, u, far: steps to the sink over edges with room, of the vertices that reach it."""
    level = ends.select("graph_id", F.col("sink").alias("u"), F.lit(0).alias("far"))
    open_edges = rooms.where("room > 0").select("graph_id", "u", "v")
    seen, far = [level], 0
    while True:
        far += 1
        back = batch_hint(level)(level.select("graph_id", F.col("u").alias("v")))
        found = open_edges.join(back, ["graph_id", "v"]).select("graph_id", "u").distinct()
        known = _union([s.select("graph_id", "u") for s in seen])
        level = materialize(found.join(batch_hint(known)(known), ["graph_id", "u"], "left_anti").withColumn("far", F.lit(far)), "flow-level")
        if not level.head(1):
            return _union(seen)
        seen.append(level)


def pushes_of(rooms: DataFrame, held: DataFrame, far: DataFrame, hint: Hint = shuffled) -> DataFrame:
    """graph_id, u, v, push: every excess, along edges that lead one step nearer. hint: of the tables of vertices."""
    active = held.where("excess > 0").join(hint(far), ["graph_id", "u"]).where("far > 0")
    nearer = far.select("graph_id", F.col("u").alias("v"), (F.col("far") + 1).alias("far"))
    able = rooms.where("room > 0").join(hint(active), ["graph_id", "u"]).join(hint(nearer), ["graph_id", "v", "far"])
    able = able.withColumn("slot", F.pmod(F.xxhash64("v"), F.lit(SLOTS)))
    slots = able.groupBy("graph_id", "u", "slot").agg(F.sum("room").alias("all"))
    before = W.partitionBy("graph_id", "u").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    slots = slots.select("graph_id", "u", "slot", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("graph_id", "u", "slot").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    able = able.join(shuffled(slots), ["graph_id", "u", "slot"]).withColumn("earlier", F.col("base") + F.coalesce(F.sum("room").over(inside), F.lit(0)))
    push = F.least("room", F.col("excess") - F.col("earlier"))
    return able.select("graph_id", "u", "v", push.alias("push")).where("push > 0")


def max_flow(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """edges: graph_id, src, dst, capacity; ends: graph_id, source, sink -> graph_id, max_flow."""
    return solve(edges, ends)[0]


def solve(edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The flows; the room that is left on every edge; which vertices still reach the sink (graph_id, u, far): the
    least cut lies between these and all others."""
    if edges.where("capacity < 0").head(1):
        raise ValueError("a capacity is negative")
    ends = materialize(ends.select("graph_id", "source", "sink").distinct(), "flow-ends")
    real = ends.where("source <> sink")
    rooms = materialize(residual(edges).join(real.select("graph_id"), "graph_id"), "flow-edges")
    start = rooms.where("room > 0").join(real.select("graph_id", F.col("source").alias("u")), ["graph_id", "u"])
    first = materialize(start.select("graph_id", "u", "v", F.col("room").alias("push")), "flow-push")
    # The source gives whatever its edges take; its own excess isn't looked at.
    sources = real.select("graph_id", F.col("source").alias("u"))
    zero = real.select("graph_id", F.col("sink").alias("u"), F.lit(0).cast("long").alias("excess"))
    held, pushes = zero, [first]
    while True:
        rooms = materialize(_after(rooms, pushes), "flow-edges")
        held = materialize(_held(held, pushes).join(sources, ["graph_id", "u"], "left_anti"), "flow-held")
        far = materialize(distances(rooms, real), "flow-far")
        hint = batch_hint(far)
        pushes = []
        while len(pushes) < ROUNDS_A_WRITE:
            found = materialize(pushes_of(_after(rooms, pushes), _held(held, pushes), far, hint), "flow-push")
            if not found.head(1):
                break
            pushes.append(found)
        if not pushes:
            break
    at_sink = held.join(real.select("graph_id", F.col("sink").alias("u")), ["graph_id", "u"]).select("graph_id", "excess")
    flows = ends.select("graph_id").join(at_sink, "graph_id", "left").select("graph_id", F.coalesce("excess", F.lit(0)).cast("long").alias("max_flow"))
    return flows, rooms, far
