"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product is made nearest distance: each vector gets one more component, so that all have the longest
vector's norm, and a query is scaled to that norm with a zero there. `DIMS` Gaussian (2-stable) projections of these
are indexed by a kd-tree; for a vector at distance d the squared projected distance over d squared is chi-square
distributed. A query verifies its projected neighbours on the original vectors, nearest first, and stops when the
next is so far that a vector as near as the k-th best so far would lie beyond it with a probability of at most
1 - `CERTAINTY`. Leaves whose boxes lie beyond that distance are not opened.

The tree's upper levels are cut on a bounded sample (`SAMPLE` vectors) into cells; every vector is indexed in its
cell, and a cell with more than its share (say of equal vectors) is split into blocks by row. A query first searches
its own block, which gives it a k-th best score; the stopping test then tells which other cells it has to visit, with
that score to beat. A task reads a block's vectors once and then streams all queries past them: vectors are shuffled
once for each of the two passes, whatever the number of queries, and a query goes to the blocks that the test leaves.
Cells grow with the table (`CELL` to `CELL_MOST` vectors), so that a query is copied to few of them.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the most common one; a null vec_id takes no part. Rows are told apart: a query leaves out its own row
only, so another row of its vec_id is a candidate like any other. Rows repeated whole ask once, as their lists are
equal; rows of one vec_id with different vectors each ask, and their lists follow under the one query_id. Equal
scores rank by vec_id; fewer than k candidates are all returned; an empty table gives an empty result; further
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_slices, materialize, slots_for, small, table

DIMS, SEED = 16, 20_240_501
SAMPLE, LEAF = 20_000, 64
#: Vectors of a cell: at least, and at most beyond `CELLS` cells. A task holds one cell in memory.
CELL, CELL_MOST, CELLS = 8192, 262_144, 2048
CERTAINTY = 0.97
NEIGHBOURS, EVERY = 20, 20
#: Projected neighbours that are verified before the first test; each later step is twice as long.
FIRST_STEP = 64


def chi_square(x: float, dims: int = DIMS) -> float:
    """P(chi-square with an even number of degrees of freedom <= x)."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - exp(-x / 2) * total


def chi_square_bound(p: float, dims: int = DIMS) -> float:
    lo, hi = 0.0, 10.0 * dims + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


class Projection:
    def __init__(self, length: int, top: float, dims: int = DIMS, seed: int = SEED):
        self.matrix = np.random.default_rng(seed).standard_normal((length + 1, dims))
        self.top = top  # the largest squared norm

    def vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def scale(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(self.top / (q * q).sum(axis=1))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q * self.scale(q)[:, None]) @ self.matrix[:-1]


class Tree:
    """A kd-tree over points: `order` lists the points leaf by leaf; boxes are the leaves' regions (or tight)."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        dims = points.shape[1]
        self.cuts: list = []
        self.order, self.begin, lows, highs = [], [0], [], []
        stack = [(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf), None)]
        while stack:
            own, lo, hi, link = stack.pop()
            here = points[own]
            if len(own) > leaf and (here.max(axis=0) > here.min(axis=0)).any():
                d = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
                cut = float(np.median(here[:, d]))
                right = here[:, d] > cut
                if not right.any():
                    right = here[:, d] >= cut
                    cut = float(np.nextafter(cut, -np.inf))
                at = len(self.cuts)
                self.cuts.append([d, cut, None, None])
                if link:
                    self.cuts[link[0]][link[1]] = at
                up, low = hi.copy(), lo.copy()
                up[d], low[d] = cut, cut
                stack += [(own[right], low, hi, (at, 3)), (own[~right], lo, up, (at, 2))]
            else:
                if link:
                    self.cuts[link[0]][link[1]] = ~(len(self.begin) - 1)
                self.order.append(own)
                self.begin.append(self.begin[-1] + len(own))
                lows.append(here.min(axis=0) if tight and len(own) else lo)
                highs.append(here.max(axis=0) if tight and len(own) else hi)
        self.order = np.concatenate(self.order)
        self.low, self.high = np.array(lows), np.array(highs)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))] if self.cuts else []
        while stack:
            at, own = stack.pop()
            d, cut, left, right = self.cuts[at]
            right_side = points[own, d] > cut
            for child, rows in ((left, own[~right_side]), (right, own[right_side])):
                if child < 0:
                    out[rows] = ~child
                elif len(rows):
                    stack.append((child, rows))
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in one order, so that equal vectors have equal scores."""
    return (np.ascontiguousarray(x) * q).sum(axis=1)


class Block:
    """Vectors of one cell, leaf by leaf of a kd-tree over their projections."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, proj: Projection):
        points = proj.vectors(x)
        self.tree, self.proj = Tree(points, LEAF, tight=True), proj
        order = self.tree.order
        self.x, self.rows, self.ids, self.points = x[order], rows[order], ids[order], points[order]
        self.rough = self.x.astype(np.float32)
        self.begin = np.array(self.tree.begin)

    def search(self, q: np.ndarray, q_row: int, least: float, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best, not under `least`, that a query finds here, and how many vectors it verified."""
        proj, top = self.proj, self.proj.top
        spot, scale = proj.queries(q[None])[0], float(proj.scale(q[None])[0])

        def reach(floor: float) -> float:
            """Squared projected distance at which the test holds: d of the k-th best, times the chi-square bound."""
            return max(2 * top - 2 * scale * floor, 0.0) * bound if floor > -np.inf else np.inf

        leaves = np.nonzero(self.tree.distances(spot) <= reach(least))[0]
        if len(leaves) == len(self.begin) - 1:
            open_rows = np.arange(len(self.x))
        else:
            sizes = self.begin[leaves + 1] - self.begin[leaves]
            open_rows = np.repeat(self.begin[leaves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        gap = self.points[open_rows] - spot
        away = np.einsum("ij,ij->i", gap, gap)
        near = away <= reach(least)
        open_rows, away = open_rows[near], away[near]
        order = np.argsort(away, kind="stable")
        open_rows, away = open_rows[order], away[order]
        best_ids, best, floor, at, step = np.zeros(0, np.int64), np.zeros(0), least, 0, FIRST_STEP
        rough_q, slack = q.astype(np.float32), 1e-5 * np.sqrt(top * (q @ q))
        while at < len(away):
            stop = min(at + step, int(np.searchsorted(away, reach(floor), side="right")))
            if stop <= at:
                break
            take = open_rows[at:stop]
            rough = self.rough[take] @ rough_q
            good = take[(rough >= floor - slack) & (self.rows[take] != q_row)]
            if len(good):
                best_ids = np.concatenate([best_ids, self.ids[good]])
                best = np.concatenate([best, exact_scores(self.x[good], q)])
                first = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[first], best[first]
                if len(best) == k:
                    floor = max(floor, float(best[-1]))
            at, step = stop, step * 2
        keep = best >= least
        return best_ids[keep], best[keep], at


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the vectors that take part."""
    inf = F.lit(float("inf"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists("embedding", lambda v: v != 0)
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return own.where(fine)


#: What streams through a task: a block's vectors (kind 0), then its queries (kind 1); slot deals blocks to tasks.
STREAM = "slot long, block long, kind int, row long, id long, vec binary, least double"
FOUND = "query_row long, query_id long, vec_id long, score double, verified long"


def cell_size(total: int) -> int:
    return min(max(CELL, in_slices(total, CELLS)), CELL_MOST)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, certainty: float = CERTAINTY, cell: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for each vec_id divisible by `every`, its k nearest among the other rows.

    verified: how many vectors the query was held against in full; the others were left out by the stopping test.
    """
    spark = vectors.sparkSession
    own = valid(vectors)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    kinds = own.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.max(norm).alias("top")).orderBy(F.desc("c"), "n").first()
    if kinds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long")
    own = own.where(F.size("embedding") == kinds["n"])
    bound = chi_square_bound(certainty)
    proj = Projection(kinds["n"], kinds["top"] * (1 + 1e-12))
    sample = own.orderBy(F.xxhash64("vec_id"), F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toPandas()["embedding"]
    seen = proj.vectors(np.stack(sample.to_numpy()))
    cell = cell or cell_size(kinds["c"])
    upper = Tree(seen, max(1, -(-len(seen) // in_slices(kinds["c"], cell))), tight=False)
    shape = spark.sparkContext.broadcast((proj, upper))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj, upper = shape.value
        for f in frames:
            if len(f):
                x = np.stack(f["embedding"].to_numpy()).astype(float)
                yield pd.DataFrame({"row": f["row"], "id": f["vec_id"], "vec": [r.tobytes() for r in x], "cell": upper.leaf_of(proj.vectors(x))})

    # A row's number is fixed once it is written.
    numbered = own.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "embedding")
    placed = materialize(numbered.mapInPandas(place, "row long, id long, vec binary, cell long"), "ann-cells")
    # A row per cell; cells grow with the table, so there are a few thousand.
    subs = {r["cell"]: in_slices(r["n"], cell) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = dict(zip(sorted(subs), np.cumsum([0] + [subs[c] for c in sorted(subs)]).tolist()))
    blocks = sum(subs.values())
    slots = slots_for(spark, blocks)
    of_cell = [(c, first[c], subs[c]) for c in sorted(subs)]
    known = spark.createDataFrame(of_cell, "cell long, first long, subs long")
    named = spark.createDataFrame([(b, slots[b]) for b in range(blocks)], "block long, slot long")
    placed = placed.join(small(known, len(of_cell)), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("subs")))
    placed = placed.join(small(named, blocks), "block").select("slot", "block", "row", "id", "vec")
    model = spark.sparkContext.broadcast((proj, upper, of_cell, np.array(slots)))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj = model.value[0]
        at, held, block = None, [], None
        for f in frames:
            marks = f["block"].to_numpy() * 2 + f["kind"].to_numpy()
            ends = np.append(np.nonzero(np.diff(marks))[0] + 1, len(f))
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if a == b:
                    continue
                part = f.iloc[a:b]
                if part["block"].iloc[0] != at:
                    at, held, block = part["block"].iloc[0], [], None
                x = np.frombuffer(b"".join(part["vec"]), float).reshape(len(part), -1)
                rows, ids = part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64)
                if part["kind"].iloc[0] == 0:
                    held.append((x, rows, ids))
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(*[np.concatenate(z) for z in zip(*held)], proj), held[:1]
                yield answers(block, x, rows, ids, part["least"].to_numpy(float))

    def answers(block: Block, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, least: np.ndarray) -> pd.DataFrame:
        found = [block.search(q, r, -np.inf if np.isnan(w) else w, k, bound) for q, r, w in zip(queries, rows.tolist(), least.tolist())]
        sizes = [len(x[0]) for x in found]
        out = pd.DataFrame({
            "query_row": np.repeat(rows, sizes), "query_id": np.repeat(ids, sizes),
            "vec_id": pd.array(np.concatenate([x[0] for x in found]), "Int64"), "score": np.concatenate([x[1] for x in found]), "verified": 0,
        })
        seen = pd.DataFrame({"query_row": rows, "query_id": ids, "vec_id": pd.array([None] * len(rows), "Int64"), "score": np.nan, "verified": [x[2] for x in found]})
        return pd.concat([out, seen], ignore_index=True)

    def meet(queries: DataFrame) -> DataFrame:
        held = placed.select("slot", "block", F.lit(0).alias("kind"), "row", "id", "vec", F.lit(None).cast("double").alias("least"))
        stream = held.union(queries.select("slot", "block", F.lit(1).alias("kind"), "row", "id", "vec", "least"))
        return stream.repartition(blocks, "slot").sortWithinPartitions("block", "kind").mapInPandas(visit, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # Rows repeated whole ask once.
    asked = placed.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "vec").agg(F.min(F.struct("row", "block", "slot")).alias("at"))
    asked = materialize(asked.select("at.row", "id", "vec", "at.block", "at.slot"), "ann-queries")
    home = materialize(meet(asked.withColumn("least", F.lit(None).cast("double"))), "ann-home")
    floor = best(home).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj, upper, of_cell, slots = model.value
        cells, firsts, subs = np.array(of_cell).T
        low, high = upper.low[cells], upper.high[cells]
        for f in frames:
            for at in range(0, len(f), 64):
                part = f.iloc[at : at + 64]
                q = np.frombuffer(b"".join(part["vec"]), float).reshape(len(part), -1)
                spots, least = proj.queries(q)[:, None, :], part["least"].to_numpy(float)
                gap = np.maximum(np.maximum(low - spots, spots - high), 0)
                reach = np.where(np.isnan(least), np.inf, np.maximum(2 * proj.top - 2 * proj.scale(q) * np.nan_to_num(least), 0) * bound)
                i, c = np.nonzero((gap * gap).sum(axis=2) <= reach[:, None])
                n = subs[c]
                i, block = np.repeat(i, n), np.repeat(firsts[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                away = block != part["home"].to_numpy()[i]
                i, block = i[away], block[away]
                yield part.iloc[i].assign(slot=slots[block], block=block)[["slot", "block", "row", "id", "vec", "least"]]

    tasks = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = asked.drop("slot").withColumnRenamed("block", "home").join(floor, "row", "left").repartition(tasks, "row")
    others = materialize(meet(routed.mapInPandas(route, "slot long, block long, row long, id long, vec binary, least double")), "ann-others")
    every_find = home.union(others)
    counts = every_find.where("verified > 0").groupBy("query_row").agg(F.sum("verified").alias("verified"))
    out = best(every_find.drop("verified")).join(counts, "query_row")
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score", "verified")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_ann": op3_ann}
SQL: dict[str, str] = {}
