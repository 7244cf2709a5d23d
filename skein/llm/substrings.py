"""Removal of repeated substrings by suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a smaller doc_id, or in the same
document before. Strings are judged on the input and never cross documents.

1. Anchors. Every window of LENGTH bytes is owned by the K-byte string in it with the least hash, its anchor, so
   equal windows have equal anchors at equal places. A window can repeat only if its anchor does; everything else
   is left out, exactly. An anchor's context are the bytes of the windows that it owns.
2. Contexts that are equal to an earlier one are removed whole, by comparing digests: first inside each batch that
   a task reads (so a passage or text that many documents share is pre-aggregated before the shuffle), then over
   all, in one pass over rows sorted by anchor that keeps only the last row. What stays are the first occurrences
   of anchors that have several contexts: the places where repeated text begins and ends.
3. These contexts' bytes are dealt into shards by anchor. Each shard has a suffix array (Larsson-Sadakane) and its
   common prefixes (Kasai); neighbours that share LENGTH bytes are one class, and all but its earliest go.
   Before that, contexts of an anchor with more than `SPLIT` of them get longer anchors: the windows that have the
   anchor at one of `WIDTH` neighbouring places share all but WIDTH - 1 bytes, and step 2 is done over with these.
4. A longer anchor with more than `SPLIT` contexts is dealt over several shards, by its bytes, each of which passes on
   its surviving windows, sorted. They are dealt by content to as many mergers as that anchor's windows need, where
   the shards' runs are merged by binary search. Shards and mergers are an anchor's own, so runs grow as contexts do.
5. Spans are gathered by document, joined to the texts and cut out.

Rows are told apart by doc_id and the text's CRC-32: rows of one doc_id with different texts are documents of their
own, in the order of the CRC; rows repeated whole are one document and don't remove each other. Null doc_ids come
first. Null text is empty. Texts of any length are read whole: one is held by one task at a time. An empty table gives an
empty result; further columns, whatever their names, are kept as they are (but n_chars, which follows the text).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_slices, materialize, pack_row, small, small_batches, table, unpack_row
from .memory import trimmed
from .suffix_array import common_prefixes, suffix_array

LENGTH = 100
K = 32
SHARD_BYTES = 1_000_000
SPLIT = 200
WIDTH = 9
MIX, UPPER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF00000000)
SPAN = np.uint64(127)  # so many windows, less one, an anchor may own: LENGTH - K is less
_SHIFT = 31  # a place is crc32 << 31 | position; spans have it inverted


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least `length` bytes: each anchor's position and hash, and the first and last window it owns.

    A window's owner is the k-byte string in it with the least upper half of its hash, the leftmost of equals.
    Owners follow from the window's bytes alone, so equal windows have equal owners at equal places.
    """
    h = hashes(data, k)
    key = (h & UPPER) | np.arange(len(h), dtype=np.uint64)
    owner = (sliding(key, length - k + 1, np.minimum) & ~UPPER).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(owner[1:] != owner[:-1])[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
    at = owner[first]
    return at, h[at], first, last


def hashes(data: bytes, k: int = K) -> np.ndarray:
    """A hash of each k-byte string."""
    n = len(data) - k + 1
    lanes = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for j in range(0, k, 8):
        h = (h ^ lanes[j : j + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def sliding(x: np.ndarray, w: int, f: Callable) -> np.ndarray:
    """f over each window of w values, by doubling."""
    s = 1
    while 2 * s <= w:
        x = f(x[:-s], x[s:])
        s *= 2
    return f(x[: len(x) - (w - s)], x[w - s :]) if w > s else x


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (first is the leading one), and where the two leading keys change."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def scan(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Anchors of all texts: h, c (digest of the context, and in 7 bits or more how many windows), doc_id, place.

    Rows with place < 0 are spans, c their end.
    """
    import xxhash

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            hs, cs, ds, ps, ends = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py().encode("utf-8", "surrogatepass") if text.is_valid else b""
                if len(data) < length:
                    continue
                at, h, lo, hi = anchors(data, length, k)
                c = [digest(data[x : y + length], a - x) for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())]
                hs.append(h)
                cs.append((np.array(c, np.uint64) & ~SPAN) | (hi - lo).astype(np.uint64))
                ds.append(np.full(len(at), -(1 << 63) if doc is None else doc, np.int64))
                ps.append((zlib.crc32(data) << _SHIFT) | lo)
            if not hs:
                continue
            h, c, d, p = map(np.concatenate, (hs, cs, ds, ps))
            order, new = _first_of(h, c, d, p)
            # A row at its class's first place is that place again, by a row repeated whole; it is left out.
            head = order[np.nonzero(new)[0]][np.cumsum(new) - 1]
            again = ~new & (d[order] == d[head]) & (p[order] == p[head])
            same = order[~new & ~again]
            keep = np.ones(len(h), bool)
            keep[order[again]] = False
            c = c.view(np.int64)
            c[same] = (p[same] & ((1 << _SHIFT) - 1)) + (c[same] & int(SPAN)) + length
            # Spans go anywhere; their document deals them out.
            h[same] = (d[same].view(np.uint64) * MIX) ^ MIX
            p[same] = ~p[same]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[keep]), pa.array(c[keep]), pa.array(d[keep]), pa.array(p[keep])], names=["h", "c", "doc_id", "place"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "h long, c long, doc_id long, place long")


def collapse(found: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """Over all anchors: spans (kind 0) and contexts to be compared (kind 1), from a to b; h: the anchor."""
    if length - k > int(SPAN):
        raise ValueError("anchors own too many windows; take a greater k")
    low = (1 << _SHIFT) - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first occurrence, not known yet to have company
        last = first = None  # the last row's keys, and its class's first place
        for batch in batches:
            h, c, d, p = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            if not len(h):
                continue
            span = p < 0
            sp, sd, se = ~p[span], d[span], c[span]
            h, c, d, p = h[~span], c[~span], d[~span], p[~span]
            keep = np.zeros((0, 4), np.int64)
            if len(h):
                newh, newc = np.ones(len(h), bool), np.ones(len(h), bool)
                newh[1:] = h[1:] != h[:-1]
                newh[0] = last is None or last[0] != h[0]
                newc[1:] = newh[1:] | (c[1:] != c[:-1])
                newc[0] = newh[0] or last[1] != c[0]
                last = (h[-1], c[-1])
                # Each row's class begins at its first row, which may lie in a batch before.
                at = np.cumsum(newc) - 1
                d0, p0 = np.append(d[newc], 0)[at], np.append(p[newc], 0)[at]
                if first is not None:
                    d0[at < 0], p0[at < 0] = first
                first = (d0[-1], p0[-1])
                dup = ~newc & ((d != d0) | (p != p0))
                sp = np.concatenate([sp, p[dup]])
                sd = np.concatenate([sd, d[dup]])
                ends = (p & low) + (c & int(SPAN)) + length
                se = np.concatenate([se, ends[dup]])
                reps = np.stack([h[newc], d[newc], p[newc], ends[newc]], axis=1)
                fresh = np.ones(len(reps), bool)  # not yet emitted
                if held is not None:
                    reps, fresh = np.concatenate([held[0][None], reps]), np.concatenate([[held[1]], fresh])
                if len(reps):
                    company = np.zeros(len(reps), bool)
                    like = reps[1:, 0] == reps[:-1, 0]
                    company[1:] |= like
                    company[:-1] |= like
                    keep = reps[company & fresh]
                    held = (reps[-1], bool(fresh[-1] and not company[-1]))
            kind = np.concatenate([np.zeros(len(sp), np.int32), np.ones(len(keep), np.int32)])
            place = np.concatenate([sp, keep[:, 2]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (kind, np.concatenate([sd, keep[:, 1]]), place >> _SHIFT, place & low, np.concatenate([se, keep[:, 3]]), np.concatenate([np.zeros(len(sp), np.int64), keep[:, 0]]))],
                names=["kind", "doc_id", "crc", "a", "b", "h"],
            )

    dealt = found.repartition("h").sortWithinPartitions("h", "c", "doc_id", "place")
    return dealt.mapInArrow(each, "kind int, doc_id long, crc long, a long, b long, h long")


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the spans [a, b)."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    ends = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(a) - 1]])
    return a[new], b[ends]


def with_texts(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """docs' doc_id, text joined to rows by (doc_id, crc)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    own = docs.withColumn("__d", key).withColumn("__c", crc)
    other = per_doc.select(F.col("doc_id").alias("__d2"), F.col("crc").alias("__c2"), *[c for c in per_doc.columns if c not in ("doc_id", "crc")])
    return own.join(other, (F.col("__d") == F.col("__d2")) & (F.col("__c") == F.col("__c2")), how).drop("__d2", "__c2")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (doc_id, crc, a, b, h, shard, merges)."""
    lists = wanted.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("a", "b", "h", "shard", "merges")).alias("wanted"))
    joined = with_texts(docs.select("doc_id", "text"), lists, "inner")
    joined = joined.select("__d", "__c", F.col("text").cast("binary").alias("text"), "wanted")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, per = batch.column(3).flatten(), batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            a, b = (lists.field(x).to_numpy(zero_copy_only=False) for x in ("a", "b"))
            cuts, at, found = list(zip(a.tolist(), b.tolist())), 0, []
            for data, n in zip(batch.column(2).to_pylist(), per.tolist()):
                found += [data[x:y] for x, y in cuts[at : at + n]]
                at += n
            doc, crc = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), per) for i in (0, 1))
            columns = [lists.field("shard"), lists.field("merges"), lists.field("h"), pa.array(doc), pa.array(crc), pa.array(a), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "merges", "h", "doc_id", "crc", "a", "bytes"])

    return joined.mapInArrow(each, "shard long, merges long, h long, doc_id long, crc long, a long, bytes binary")


def finer(held: DataFrame, length: int = LENGTH, k: int = K, width: int = WIDTH) -> DataFrame:
    """Contexts with their bytes -> rows as of `scan`, of longer anchors.

    A window that begins i bytes before its anchor belongs to group i // width. All windows of a group hold the same
    length - width + 1 bytes around the anchor, the longer anchor; equal windows have equal ones at equal places.
    """
    import xxhash

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc, crc, a = (batch.column(x).to_numpy() for x in ("h", "doc_id", "crc", "a"))
            blobs = batch.column("bytes").to_pylist()
            sizes = np.array([len(x) for x in blobs])
            base = np.cumsum(sizes) - sizes
            # The anchor's first place in a context is its place: an earlier one would own the first window.
            hit = np.nonzero(hashes(b"".join(blobs), k).view(np.int64) == np.repeat(h, sizes)[: sizes.sum() - k + 1])[0]
            at = hit[np.searchsorted(hit, base)] - base
            rows = []
            for i, (data, o, n) in enumerate(zip(blobs, at.tolist(), (sizes - length).tolist())):
                for g in range(max(0, o - n) // width, o // width + 1):
                    x, y = max(0, o - g * width - width + 1), min(n, o - g * width)  # first and last window of the group
                    core = o - g * width
                    rows.append((i, x, y - x, digest(data[core : core + length - width + 1], g), digest(data[x : y + length], core - x)))
            i, x, more, h2, c = (np.array(v, kind) for v, kind in zip(zip(*rows), (np.int64, np.int64, np.uint64, np.uint64, np.uint64)))
            columns = [h2.view(np.int64), ((c & ~SPAN) | more).view(np.int64), doc[i], (crc[i] << _SHIFT) | (a[i] + x)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["h", "c", "doc_id", "place"])

    return held.mapInArrow(each, "h long, c long, doc_id long, place long")


def classes(f: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """One shard: the spans that start earlier elsewhere in it (kind 0), and split anchors' survivors (kind 1).

    Survivors are dealt by content to their anchor's `merges` mergers; each gets one sorted run from this shard, in one
    row. A run's doc_id is the anchor, b the merger.
    """
    import xxhash

    blobs = f["bytes"].tolist()
    sizes = np.array([len(x) for x in blobs])
    text = np.frombuffer(b"".join(blobs), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text, sa, rank)
    ctx = np.repeat(np.arange(len(blobs)), sizes)
    inner = np.arange(len(text)) - base[ctx]
    start = inner + length <= sizes[ctx]  # a window starts here and ends in its context
    cls = np.cumsum(lcp < length)
    take = start[sa]
    sa, cls = sa[take], cls[take]
    doc, crc = (f[x].to_numpy(np.int64)[ctx[sa]] for x in ("doc_id", "crc"))
    at = f["a"].to_numpy(np.int64)[ctx[sa]] + inner[sa]
    # Only classes of several windows need their earliest; the others stay, and pass on if their anchor is split.
    alone = np.ones(len(cls), bool)
    alone[1:] = cls[1:] != cls[:-1]
    alone[:-1] &= alone[1:]
    merges = f["merges"].to_numpy(np.int64)
    split = merges > 0
    if not split.any():
        sa, cls, doc, crc, at = sa[~alone], cls[~alone], doc[~alone], crc[~alone], at[~alone]
    order = np.lexsort((at, crc, doc, cls))
    c, d, crc, p = cls[order], doc[order], crc[order], at[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    head = np.nonzero(new)[0][np.cumsum(new) - 1]
    late = (d != d[head]) | (crc != crc[head]) | (p != p[head])
    out = [spans(d[late], crc[late], p[late], length)]
    keep = new & split[ctx[sa[order]]]
    if keep.any():
        whole, places = text.tobytes(), sa[order[keep]]
        windows = [whole[x : x + length] for x in places.tolist()]
        anchor, of = f["h"].to_numpy(np.int64)[ctx[places]], merges[ctx[places]]
        dealt = np.array([xxhash.xxh3_64_intdigest(w) % m if m > 1 else 0 for w, m in zip(windows, of.tolist())])
        members = np.stack([d[keep], crc[keep], p[keep]], axis=1)
        order = np.lexsort((dealt, anchor))  # stable, so each run is sorted, as classes are
        begin = np.nonzero(np.concatenate([[True], (np.diff(anchor[order]) != 0) | (np.diff(dealt[order]) != 0)]))[0]
        runs = np.split(order, begin[1:])
        first = order[begin]
        found = {"bytes": [b"".join([windows[i] for i in own.tolist()]) for own in runs], "members": [members[own].tobytes() for own in runs]}
        out.append(pd.DataFrame({"kind": np.int32(1), "doc_id": anchor[first], "crc": 0, "a": 0, "b": dealt[first]} | found))
    return pd.concat(out, ignore_index=True)


def spans(doc: np.ndarray, crc: np.ndarray, at: np.ndarray, length: int) -> pd.DataFrame:
    """Windows at `at`, joined to spans within each document."""
    order = np.lexsort((at, crc, doc))
    d, c, p = doc[order], crc[order], at[order]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (p[1:] > p[:-1] + length)
    ends = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(p) - 1]]) if len(p) else np.zeros(0, np.int64)
    return pd.DataFrame({"kind": np.int32(0), "doc_id": d[new], "crc": c[new], "a": p[new], "b": p[ends] + length, "bytes": None, "members": None})


def merge_runs(f: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """The spans of survivors that start earlier in another shard. Sorted runs are merged one by one by binary search."""
    runs = [np.array([b[i : i + length] for i in range(0, len(b), length)], object) for b in f["bytes"]]
    members = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 3) for m in f["members"]])
    known = runs[0]
    for own in runs[1:]:
        place = np.searchsorted(known, own)
        hit = np.zeros(len(own), bool)
        inside = place < len(known)
        hit[inside] = known[place[inside]] == own[inside]
        known = np.insert(known, place[~hit], own[~hit])
    ids = np.searchsorted(known, np.concatenate(runs))
    doc, crc, at = members.T
    order = np.lexsort((at, crc, doc, ids))
    i, d, crc, p = ids[order], doc[order], crc[order], at[order]
    new = np.ones(len(i), bool)
    new[1:] = i[1:] != i[:-1]
    head = np.nonzero(new)[0][np.cumsum(new) - 1]
    late = (d != d[head]) | (crc != crc[head]) | (p != p[head])
    return spans(d[late], crc[late], p[late], length)


SPAN_SCHEMA = "kind int, doc_id long, crc long, a long, b long, bytes binary, members binary"


def crowded(spots: DataFrame, split: int) -> DataFrame:
    """h, n, bytes of the anchors with more than `split` contexts."""
    per = spots.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("bytes"))
    return per.where(F.col("n") > split)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, shard_bytes: int = SHARD_BYTES, split: int = SPLIT) -> DataFrame:
    """doc_id, crc, spans (array of a, b; maybe overlapping) of every document with something to remove."""
    rows = materialize(collapse(scan(docs, length, k), length, k), "anchors")
    spots, every = rows.where("kind = 1"), rows.where("kind = 0")
    hot = materialize(crowded(spots, split), "hot-anchors")
    n, none = hot.count(), F.lit(0).cast("long")
    if n:
        again = spots.join(small(hot.select("h"), n), "h").select("doc_id", "crc", "a", "b", "h", none.alias("shard"), none.alias("merges"))
        again = materialize(collapse(finer(contexts(docs, again), length, k), length, k), "finer-anchors")
        spots = spots.join(small(hot.select("h"), n), "h", "left_anti").unionByName(again.where("kind = 1"))
        every = every.union(again.where("kind = 0"))
        hot = materialize(crowded(again.where("kind = 1"), split), "hot-anchors")
        n = hot.count()
    shards = in_slices(spots.agg(F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()[0], shard_bytes)
    # Of a split anchor: half a shard's bytes to a part, four shards' bytes of windows to a merger.
    pieces = F.greatest(F.lit(2), F.ceil(F.col("bytes") * 2 / shard_bytes)).cast("long")
    merges = F.ceil((F.col("bytes") - F.col("n") * (length - 1)) * length / (4 * shard_bytes)).cast("long")
    hot = hot.select("h", pieces.alias("pieces"), merges.alias("merges"))
    piece = F.pmod(F.xxhash64("doc_id", "crc", "a"), F.coalesce("pieces", F.lit(1)))
    marked = spots.join(small(hot, n), "h", "left").withColumn("shard", F.pmod(F.xxhash64("h", piece), F.lit(shards)))
    marked = marked.select("doc_id", "crc", "a", "b", "h", "shard", F.coalesce("merges", none).alias("merges"))
    local = contexts(docs, marked).groupBy("shard").applyInPandas(lambda f: classes(f, length), SPAN_SCHEMA)
    local = materialize(local, "shard-spans")
    across = local.where("kind = 1").groupBy("doc_id", "b").applyInPandas(lambda f: merge_runs(f, length), SPAN_SCHEMA)
    every = every.select("doc_id", "crc", "a", "b")
    for part in (local.where("kind = 0"), across):
        every = every.union(part.select("doc_id", "crc", "a", "b"))
    return every.groupBy("doc_id", "crc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def cut(data: bytes, found) -> tuple[bytes, int, int]:
    """What stays of a text, bytes removed, number of maximal removed runs."""
    if found is None or not len(found):
        return data, 0, 0
    a = np.array([x["a"] for x in found], np.int64)
    b = np.minimum(np.array([x["b"] for x in found], np.int64), len(data))
    a, b = _merged(a, b)
    parts, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        parts.append(data[at:x])
        at = y
    parts.append(data[at:])
    return b"".join(parts), int((b - a).sum()), len(a)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without their repeated substrings: the same rows and columns, texts shortened.

    Code points of which only a part would stay go whole; n_chars follows the text.
    """
    own = docs.columns
    joined = with_texts(pack_row(small_batches(docs), "doc_id", "text"), repeated_spans(docs.select("doc_id", "text"), **options), "left")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                keep.append(text if text is None or found is None else cut(text.encode(), found)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keep, pa.string()), b.column("__row")], names=["doc_id", "text", "__row"])

    out = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans", "__row")
    schema = T.StructType([f for f in out.schema.fields if f.name != "spans"])
    out = unpack_row(out.mapInArrow(trimmed(each), schema), own, "doc_id", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in own else out


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_texts(docs, repeated_spans(docs), "left").select("doc_id", "text", "spans")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for f in frames:
            rows = []
            for text, found in zip(f["text"], f["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, runs = cut(data, found)
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64"))
            yield out

    return joined.mapInPandas(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OP10_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT rid, doc_id, p, array_slice(b, p + 1, p + {LENGTH}) AS s FROM d, unnest(range(greatest(octet_length(b) - {LENGTH - 1}, 0))) AS u(p)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, p) AS nth FROM w
), later AS (
  SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM firsts WHERE nth > 1
), marked AS (
  SELECT rid, p, sum(CASE WHEN before IS NULL OR p > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS run FROM later
), runs AS (
  SELECT rid, min(p) AS a, max(p) + {LENGTH} AS e FROM marked GROUP BY rid, run
), spans AS (
  SELECT rid, list(a ORDER BY a) AS l, list(e ORDER BY a) AS r, sum(e - a) AS removed, count(*) AS n FROM runs GROUP BY rid
), j AS (
  SELECT doc_id, b, coalesce(removed, 0)::BIGINT AS removed, coalesce(n, 0) AS n, list_append(coalesce(l, []), octet_length(b)) AS ends, list_prepend(0, coalesce(r, [])) AS begins
  FROM d LEFT JOIN spans USING (rid)
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, removed AS n_removed, n AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, n + 2), lambda i: hex(array_slice(b, begins[i] + 1, ends[i]))), ''))) AS kept_sha256
FROM j
"""

QUERIES = {"op10_substrings": op10_substrings}
SQL = {"op10_substrings": OP10_SQL}
