"""Near copies: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates come from SimHash fingerprints of the shingle sets first: generalised pigeonhole with thresholds by dynamic
programming (`simhash.links`) finds all pairs within `RADIUS` bits; the least node stands for its fingerprint. A pair at
0.8 differs in 9.7 bits on average, out of reach of any radius that is less than comparing all with a constant share of
all. So there are `BANDS` keys of `ROWS` minhashes each too; texts that share a key are candidates. A pair at 0.8 shares
none with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million; a pair above, less. Every candidate is then held to
the exact likeness of both whole shingle sets, so nothing below 0.8 links. Linked texts are connected.

Texts of one shingle set are one node. Nodes of a key never meet as pairs at first: each is compared with the
least node of its key only. Of what that leaves in different components of one key, nodes go that can't link: those
of whose shingles under 0.8 lie in a node of any other component (`linkable`). The rest is compared pair by pair inside
a salted join that lets only links out; so components are those of all candidate pairs, while a large group of copies
costs a comparison per member. Texts of one family just under 0.8 stay apart, so among them comparisons, though not
rows, grow with the square of the family.

Defined cases: words are runs of anything but the six ASCII spaces, A-Z as a-z; fewer than five words: the whole
sequence is the shingle; null texts and texts without words are all alike; texts of any length are read whole; a null
doc_id is a document too, and is kept before all others; rows repeated whole are copies; an empty table gives an empty
result; further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, small_batches, text_slices
from .components import components
from .memory import trimmed
from .simhash import RADIUS, keep_first, majorities
from .simhash import links as pigeonhole

SEED, SHINGLE = 42, 5
#: Likeness of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 24, 4
#: Tasks that a key's nodes are dealt to where pairs of them are compared.
SALTS = 2
#: Shingles that are hashed at once, and characters of texts.
BLOCK, SLICE = 2_000, 1 << 20

_RANDOM = np.random.default_rng(SEED)
_XOR, _ODD = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_PLACES = _RANDOM.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w, SEED) for w in words], np.uint64)
    size = len(words) - n + 1
    total = np.zeros(size, np.uint64)
    for j in range(n):
        total += mixed(each[j : j + size] * _PLACES[j])
    return np.unique(mixed(total))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key per band; a set without shingles has the same keys as any other such set."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), BLOCK):
        np.minimum(least, ((own[at : at + BLOCK, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def node_of(own: np.ndarray) -> int:
    """A 64-bit name of a shingle set, as a signed long."""
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, size (number of shingles), keys, fp (the set's SimHash)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in text_slices(texts, SLICE):
                sets = [shingles(t) for t in texts[part]]
                sizes = np.array([len(s) for s in sets], np.int64)
                fps = majorities(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes)
                keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64)
                own = b.slice(part.start, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id"), own.column("text_hash"), pa.array(np.array([node_of(s) for s in sets], np.int64)), pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys)), pa.array(fps.view(np.int64)),
                    ],
                    names=["doc_id", "text_hash", "node", "size", "keys", "fp"],
                )

    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(trimmed(each), "doc_id long, text_hash long, node long, size long, keys array<long>, fp long")


def with_shingles(texts: DataFrame) -> DataFrame:
    """node, text -> node, shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for part in text_slices(texts, SLICE):
                sets = [shingles(t) for t in texts[part]]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("node").slice(part.start, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    return small_batches(texts).select("node", "text").mapInArrow(trimmed(each), "node long, shingles array<long>")


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def likeness_fits() -> Column:
    """Whether the shingle sets sa and sb reach the bound."""
    return F.size(F.array_intersect("sa", "sb")) * (NUMERATOR + DENOMINATOR) >= (F.size("sa") + F.size("sb")) * NUMERATOR


def alike(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose likeness reaches the bound; `held`: node, shingles of every node that is named."""
    one = held.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = held.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").where(likeness_fits()).select("a", "b")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """node, size, fp -> a, na, b, nb: each node with the least of its fingerprint, and the least of near fingerprints."""
    heads = nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("l"))
    heads = materialize(heads.select("fp", F.col("l.node").alias("head"), F.col("l.size").alias("n")), "near-prints")
    near = pigeonhole(heads.select("fp"), heads.count(), RADIUS).distinct()
    one = heads.select(F.col("fp").alias("a"), F.col("head").alias("x"), F.col("n").alias("na"))
    two = heads.select(F.col("fp").alias("b"), F.col("head").alias("y"), F.col("n").alias("nb"))
    near = near.join(one, "a").join(two, "b").select(F.col("x").alias("a"), "na", F.col("y").alias("b"), "nb")
    same = nodes.join(heads, "fp").where("node <> head")
    return same.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("head").alias("b"), F.col("n").alias("nb")).union(near)


def linkable(left: DataFrame, held: DataFrame) -> DataFrame:
    """Of left (node, root) the nodes that a node of another root may be like, and how many of their shingles lie in any.

    Of a node that links, at least 0.8 of its shingles lie in nodes of other roots. Those that have less go, which leaves
    others with less; done over while a twentieth or more go. However often, no link is lost.
    """
    left, before = left.select("node", "root", F.lit(0).cast("long").alias("shared")), left.count()
    while before:
        rows = left.join(held, "node").select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
        shared = rows.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("s")
        found = rows.join(shared, "s").groupBy("node", "root", "size").agg(F.count(F.lit(1)).alias("shared"))
        left = materialize(found.where(F.col("shared") * DENOMINATOR >= F.col("size") * NUMERATOR).select("node", "root", "shared"), "near-linkable")
        now = left.count()
        if now * 20 > before * 19:
            break
        before = now
    return left


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, root of every row of docs (doc_id, text); root names the component."""
    rows = materialize(with_keys(docs), "near-keys")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = materialize(nodes, "near-nodes")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    # Keys of one node alone find nothing.
    least = members.groupBy("key").agg(F.min(F.struct("node", "size")).alias("l"), F.max("node").alias("m")).where(F.col("l.node") < F.col("m"))
    least = materialize(least.select("key", F.col("l.node").alias("least"), F.col("l.size").alias("least_size")), "near-least")
    members = materialize(members.join(small(least, least.count()), "key"), "near-members")
    first = members.where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("least").alias("b"), F.col("least_size").alias("nb"))
    first = first.union(by_fingerprint(nodes.select("node", "size", "fp"))).where(sizes_fit(F.col("na"), F.col("nb")))
    first = materialize(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-first")

    named = members.select("node").union(first.select("a")).union(first.select("b")).distinct().join(nodes.select("node", "at"), "node")
    named = materialize(named.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")), "near-named")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    same = texts.doc_id.eqNullSafe(named.doc_id) & (texts.text_hash == named.text_hash)
    held = texts.join(small(named, named.count()), same).select("node", "text")
    held = materialize(with_shingles(held).dropDuplicates(["node"]), "near-shingles")

    links = materialize(alike(first, held), "near-links")
    roots = materialize(components(links), "near-roots")
    # What is left in a key: nodes of different components.
    members = materialize(rooted(members, roots), "near-rooted")
    open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    some = linkable(materialize(members.join(open_keys, "key").select("node", "root").distinct(), "near-apart"), held)
    members = members.join(small(some.select("node", "shared"), some.count()), "node")
    open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    members = members.join(materialize(open_keys, "near-open"), "key").join(nodes.select("node", "keys"), "node").join(held, "node")
    members = materialize(members, "near-left")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    one = members.select("key", salt.alias("salt"), "root", F.col("node").alias("a"), F.col("size").alias("na"), F.col("shared").alias("ia"), F.col("keys").alias("ka"), F.col("shingles").alias("sa"))
    two = members.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("root").alias("other"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("shared").alias("ib"), F.col("keys").alias("kb"), F.col("shingles").alias("sb"))
    # Two nodes of different components have no more shingles in common than either has in others at all.
    reach = F.least("ia", "ib") * (NUMERATOR + DENOMINATOR) >= (F.col("na") + F.col("nb")) * NUMERATOR
    # Band by band, the first key that both have: a pair is held to the exact likeness there alone, and only links leave the join.
    meet = F.get(F.filter(F.zip_with("ka", "kb", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0)) == one.key
    near = (one.key == two.key) & (one.salt == two.salt) & (F.col("root") < F.col("other")) & sizes_fit(F.col("na"), F.col("nb")) & reach & meet & likeness_fits()
    more = one.join(two, near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = materialize(more, "near-rest")
    if more.head(1):
        roots = materialize(components(links.union(more)), "near-roots")
    named = rows.select("doc_id", "text_hash", "node").join(small(roots, roots.count()), "node", "left")
    return named.select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays, the one with the smallest doc_id (null first), all columns as they were."""
    return keep_first(docs, near_copies(docs))
