"""Sharding by k-d tree partitioning.

Every document is a point of metadata dimensions with a weight in bytes. The tree is grown level by level: at
each level all open nodes choose their widest dimension (range over the whole table's range), and are cut at
the weighted median along it, until their leaves reach a target size (`target_bytes`), or until there are as many
leaves as shards (`leaves`); both together end at what comes first.

Medians are found without sorting: a coordinate is the pair (dimension's value, hash of the text), packed into
one order-preserving number below 2**62, and the median's cell is narrowed by a histogram of at most `BINS` cells
per open node and pass until it is one coordinate. The histograms stay in the cluster; one row per node and pass
reaches the driver, and the cuts of a level go back as a table of as many rows, broadcast within a checked bound.
Since the hash breaks ties, a dimension with few values still cuts near the middle.

All dimensions are functions of the text alone, so equal texts are one point and share a shard by construction;
a group of copies is never split, and no task ever gathers one. The balance is as near as whole groups permit: a
group at the cut goes to the side that it unbalances less.

Defined cases: null text counts 1 byte (0 and 1) and lies with the empty texts; a text of any length is one point; a
null doc_id is a document too; rows repeated whole share a shard and have slots of their own, in any order; nodes of
one distinct text aren't cut, whatever their size; dimensions equally wide: the first one; empty table: empty result;
further columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_slices, materialize, running_sum, small, table

#: Cells of all nodes' histograms together, and of one node's at least.
CELLS, BINS = 1 << 17, 256
HASH_BITS = 31
SHARDS = 8
ROWS_PER_BUCKET = 2_000
DIMS = ("length", "beyond_ascii", "lines", "word_length")


@dataclass
class Node:
    key: int  # 1 at the top; 2 * key and 2 * key + 1 below
    leaves: int | None  # how many shards it is to be; None: as many as its bytes need
    weight: int
    lo: int  # the least and greatest coordinate along its widest dimension; once cut, both are the cut
    hi: int
    dim: int
    below: int = 0  # weight of the coordinates before lo

    def goal(self) -> float:
        return self.weight / 2 if self.leaves is None else self.weight * (self.leaves // 2) / self.leaves


def text_metadata(text: Column) -> dict[str, Column]:
    """Non-negative integers below 2**31 that depend on the text only."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    most = F.lit((1 << 31) - 1)
    return {
        "length": chars.cast("long"),
        "beyond_ascii": F.expr("least((octet_length(coalesce(text, '')) - length(coalesce(text, ''))) * 1000L div greatest(length(coalesce(text, '')), 1), 2147483647L)"),
        "lines": (chars - F.length(F.translate(text, "\n", ""))).cast("long"),
        "word_length": F.least(F.floor(chars.cast("long") * F.lit(1000) / (F.lit(1) + chars - F.length(F.translate(text, " ", "")))), most).cast("long"),
    }


def text_hash(text: Column) -> Column:
    """31 bits of the text's MD5."""
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long"), 1)


def along(dims: list[str], dim: Column) -> Column:
    """A point's coordinate along the dimension of that number: (value, hash) as one long that sorts like the pair."""
    value = F.element_at(F.array(*[F.col(d).cast("long") for d in dims]), dim + 1)
    return F.shiftleft(value, HASH_BITS).bitwiseOR(F.col("__h"))


def step_down(placed: DataFrame, cuts: DataFrame, n: int, dims: list[str]) -> DataFrame:
    """Points with __node moved to the half of their node that they lie in; cuts: key, dim, cut."""
    joined = placed.join(small(cuts, n), F.col("__node") == F.col("key"), "left")
    below = F.col("__node") * 2 + (along(dims, F.col("dim")) > F.col("cut")).cast("long")
    return joined.withColumn("__node", F.coalesce(below, F.col("__node"))).drop("key", "dim", "cut")


def grow(points: DataFrame, dims: list[str], leaves: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """points (the dimensions, __h below 2**31, __weight) with __node, and each leaf node's number, from left to right."""
    if leaves is None and target_bytes is None:
        raise ValueError("give a number of leaves or their target size")
    spark = points.sparkSession
    spread = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = [max(1, (spread[f"hi_{d}"] or 0) - (spread[f"lo_{d}"] or 0)) for d in dims]
    placed = points.withColumn("__node", F.lit(1).cast("long"))
    shares: dict[int, int | None] = {1: leaves}
    done: set[int] = set()
    while True:
        # One row per node.
        found = placed.groupBy("__node").agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("__weight").alias("w"), F.min("__h").alias("h0"), F.max("__h").alias("h1")).collect()
        nodes = []
        for r in found:
            key = r["__node"]
            if key in done:
                continue
            wide = max(range(len(dims)), key=lambda i: ((r[f"hi_{dims[i]}"] - r[f"lo_{dims[i]}"]) / whole[i], -i))
            lo, hi = r[f"lo_{dims[wide]}"] << HASH_BITS, (r[f"hi_{dims[wide]}"] << HASH_BITS) | ((1 << HASH_BITS) - 1)
            if (shares[key] or 2) > 1 and (target_bytes is None or r["w"] > target_bytes) and (r["h0"] < r["h1"] or leaves is not None):
                nodes.append(Node(key, shares[key], r["w"], lo, hi, wide))
            else:
                done.add(key)
        if not nodes:
            break
        narrow(placed, nodes, dims)
        cuts = spark.createDataFrame([(n.key, n.dim, n.lo) for n in nodes], "key long, dim int, cut long")
        placed = step_down(placed, cuts, len(nodes), dims)
        for n in nodes:
            half = None if n.leaves is None else n.leaves // 2
            shares[2 * n.key], shares[2 * n.key + 1] = half, None if half is None else n.leaves - half
    split = {k // 2 for k in shares if k > 1}
    depth = max(k.bit_length() for k in shares)
    ends = sorted((k for k in shares if k not in split), key=lambda k: k << (depth - k.bit_length()))
    if leaves is None or target_bytes is not None:
        return placed, {k: i for i, k in enumerate(ends)}
    first, number = {1: 0}, {}
    for k in sorted(shares):
        if k in split:
            first[2 * k], first[2 * k + 1] = first[k], first[k] + shares[k] // 2
        else:
            number[k] = first[k]
    return placed, number


def narrow(placed: DataFrame, nodes: list[Node], dims: list[str]) -> None:
    """Set lo and hi of each node to its cut: coordinates up to it go left."""
    spark = placed.sparkSession
    live = [n for n in nodes if n.lo < n.hi]
    while live:
        bins = max(BINS, CELLS // len(live))
        wide = {n.key: -(-(n.hi - n.lo + 1) // bins) for n in live}
        state = spark.createDataFrame([(n.key, n.dim, n.lo, n.hi, wide[n.key], n.goal() - n.below) for n in live], "key long, dim int, lo long, hi long, step long, goal double")
        inside = placed.join(small(state, len(live)), F.col("__node") == F.col("key")).withColumn("x", along(dims, F.col("dim"))).where("x between lo and hi")
        cells = inside.groupBy("key", F.expr("(x - lo) div step").alias("cell")).agg(F.sum("__weight").alias("w"), F.first("goal").alias("goal"))
        # A node's cells meet in one task, `bins` of them at most; its median's cell is one row.
        order = W.partitionBy("key").orderBy("cell")
        cells = cells.withColumn("till", F.sum("w").over(order)).where("till >= goal")
        found = cells.groupBy("key").agg(F.min(F.struct("cell", "w", "till")).alias("m")).select("key", "m.*").collect()
        at = {r["key"]: r for r in found}
        for n in live:
            c, w, below = at[n.key]["cell"], at[n.key]["w"], n.below + at[n.key]["till"] - at[n.key]["w"]
            a = n.lo + c * wide[n.key]
            if wide[n.key] == 1:  # one point, which goes to the side that it unbalances less
                n.lo = n.hi = a if below + w - n.goal() <= n.goal() - below else a - 1
            else:
                n.lo, n.hi, n.below = a, min(a + wide[n.key] - 1, n.hi), below
                if n.lo == n.hi:
                    n.lo = n.hi = a if below + w - n.goal() <= n.goal() - below else a - 1
        live = [n for n in live if n.lo < n.hi]


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, __weight, __crc, __shard, __slot of every row of `docs`; slots count up from 0 in each shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = text_metadata(F.col("text"))
    points = docs.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("__weight"),
        F.crc32(text.cast("binary")).alias("__crc"),
        text_hash(F.col("text")).alias("__h"),
        *[c.alias(f"__{n}") for n, c in dims.items()],
    )
    points = materialize(points, "kd-points")
    names = [f"__{n}" for n in DIMS]
    placed, number = grow(points, names, shards, target_bytes)
    numbers = points.sparkSession.createDataFrame([(k, i) for k, i in number.items()], "__node long, __shard int")
    placed = placed.join(small(numbers, len(number)), "__node")
    # Slots follow a hash of id and text; its first digits are the bucket.
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__crc"), F.col("__h")))
    slices = in_slices(points.count(), rows_per_bucket)
    bucket = F.floor(F.conv(F.substring("__row", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * slices).cast("long")
    placed = placed.withColumn("__row", key).withColumn("__one", F.lit(1).cast("long")).withColumn("__bucket", bucket)
    return running_sum(placed, ["__shard"], ["__row", "doc_id", "__crc"], "__one", "__bucket", "__slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("__weight").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 of a list of byte values b; table: what each byte's eight bits do to the remainder.
CRC32_TABLE = """SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) ORDER BY i) AS bytewise
  FROM range(256) AS r(i)"""
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda c, x: xor(c // 256, bytewise[xor(c, x) % 256 + 1])), 4294967295::BIGINT)"


def _sql() -> str:
    parts = ["""
WITH bytewise AS (""" + CRC32_TABLE + """),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT t, length(t)::BIGINT AS chars, octet_length(encode(t))::BIGINT AS bytes, ('0x' || md5(t)[1:8])::UBIGINT::BIGINT // 2 AS h
  FROM (SELECT DISTINCT t FROM d)
), bytes_of AS (
  SELECT t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda v: ('0x' || v)::BIGINT) AS l FROM b
), crcs AS (
  SELECT t, """ + CRC32.format(b="l") + """ AS crc FROM bytes_of, bytewise
), p0 AS (
  SELECT doc_id, d.t, bytes + 1 AS w, coalesce(crc, 0) AS crc, h, 0 AS node, chars AS d0, (bytes - chars) * 1000 // greatest(chars, 1) AS d1,
         chars - length(replace(d.t, chr(10), '')) AS d2, chars * 1000 // (1 + chars - length(replace(d.t, ' ', ''))) AS d3
  FROM d JOIN b USING (t) LEFT JOIN crcs USING (t)
), whole AS (
  SELECT greatest(1, max(d0) - min(d0)) AS r0, greatest(1, max(d1) - min(d1)) AS r1, greatest(1, max(d2) - min(d2)) AS r2, greatest(1, max(d3) - min(d3)) AS r3 FROM p0
)"""]
    for i in range(3):
        parts.append(f"""
, s{i} AS (
  SELECT node, sum(w) / 2 AS goal, (max(d0) - min(d0))::DOUBLE / any_value(r0) AS f0, (max(d1) - min(d1))::DOUBLE / any_value(r1) AS f1,
         (max(d2) - min(d2))::DOUBLE / any_value(r2) AS f2, (max(d3) - min(d3))::DOUBLE / any_value(r3) AS f3
  FROM p{i}, whole GROUP BY node
), x{i} AS (
  SELECT p.*, goal, (CASE greatest(f0, f1, f2, f3) WHEN f0 THEN d0 WHEN f1 THEN d1 WHEN f2 THEN d2 ELSE d3 END) * 2147483648 + h AS x
  FROM p{i} p JOIN s{i} USING (node)
), g{i} AS (
  SELECT node, x, any_value(goal) AS goal, sum(w) AS w FROM x{i} GROUP BY node, x
), k{i} AS (
  SELECT *, sum(w) OVER (PARTITION BY node ORDER BY x) AS till FROM g{i}
), c{i} AS (
  SELECT node, min(x) AS cut_x, arg_min(till - goal <= goal - (till - w), x) AS left_side FROM k{i} WHERE till >= goal GROUP BY node
), p{i + 1} AS (
  SELECT doc_id, t, w, crc, h, 2 * node + (x > cut_x OR (x = cut_x AND NOT left_side))::INT AS node, d0, d1, d2, d3 FROM x{i} JOIN c{i} USING (node)
)""")
    parts.append("""
SELECT doc_id, w AS size, crc AS text_crc32, 'bytes' AS law, node::INT AS shard,
       row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), crc, h)), doc_id, crc) - 1 AS slot,
       NULL::INT AS grown_shard
FROM p3
""")
    return "".join(parts)


QUERIES = {"op8_sharding": op8_sharding}
SQL = {"op8_sharding": _sql()}
