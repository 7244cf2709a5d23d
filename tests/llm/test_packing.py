import os
import zlib

import numpy as np
import pytest

from skein.llm import packing

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def check(rows, docs, tokenizer, window=4096):
    ids: dict = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    left = {d: sorted((len(x), x.tobytes()) for x in xs) for d, xs in ids.items()}
    pieces, at = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(left)
    for d, own in pieces.items():
        assert sum(r.length for r in own) == sum(n for n, _ in left[d])
        if len(left[d]) == 1:
            data, place = np.frombuffer(left[d][0][1], "<u4"), 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == place and r.doc_tokens == len(data) and r.ids_crc32 == zlib.crc32(data[place : place + r.length].tobytes())
                place += r.length
    padding = 0
    for own in at.values():
        end = 0
        for o, n in sorted(own):
            assert o == end and n > 0
            end += n
        assert end <= window
        padding += 0 if end & (end - 1) == 0 else window - end
    assert padding == 0


@pytest.mark.parametrize("sizes", [{}, {"shard_tokens": 800, "task_bytes": 5000}])
def test_pieces(docs, tokenizer, sizes):
    own = [(r.doc_id, r.text) for r in docs.collect()]
    check(packing.pack(docs, **sizes).collect(), own, tokenizer)


def test_like_texts_share_a_shard(spark, tokenizer):
    """Two vocabularies are told apart, and copies that are more than a task's share are dealt over several."""
    import random

    rng = random.Random(3)
    words = [[f"{p}{i}" for i in range(60)] for p in ("ka", "zu")]
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(60))) for i in range(400)] + [(1000 + i, "one text " * 30) for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), task_bytes=20_000).collect()
    check(got, rows, tokenizer)
    parts: dict = {}
    for r in got:
        if r.doc_id < 1000:
            parts.setdefault(r.sequence_id >> 32, [0, 0])[r.doc_id % 2] += 1
    assert sum(max(p) for p in parts.values()) > 0.7 * sum(sum(p) for p in parts.values())
    assert len({r.sequence_id >> 32 for r in got if r.doc_id >= 1000}) > 1


def test_reruns_agree(docs):
    a, b = (sorted(map(str, packing.pack(docs.repartition(n)).collect())) for n in (2, 7))
    assert a == b


def test_chunks_equal_whole_texts(tokenizer):
    chunks = packing.Chunks(packing.tokenizer_path(), 2)
    texts = ["It's, don't; we'll (say) \"so\". A.B, x,, y!? end.", "Ärger, ÉTÉ! é́ ǅ ﬁ 日本,語。 x\u00a0y \u2003z\x1cq", "a1 2b 33,", "İ ß ẞ Σς", "<|endoftext|> x<|startoftext|>y", "\u0301 x \n\u0301y", "", "🙂, 🙂🙂 a🙂b", "word.\nword,\tword; word"]
    for _ in range(2):
        ids, lengths, terms, counts = chunks.encode(texts)
        at = 0
        for t, n in zip(texts, lengths):
            assert ids[at : at + n].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], t
            at += n


def test_neighbours_follow_their_seed():
    topics = [["apple", "pear", "plum", "fig"], ["bolt", "nut", "gear", "cog"]]
    vocabulary = {w: i for i, w in enumerate(sorted(sum(topics, [])))}
    terms = [np.array([vocabulary[w] for w in topics[i % 2] * 2], np.uint32) for i in range(20)]
    order = []
    for doc, _, _ in packing.arrange(np.concatenate(terms), np.array([8] * 20), [10] * 20, window=50):
        if doc not in order:
            order.append(doc)
    assert [d % 2 for d in order[:10]] == [0] * 10


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(3)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(30, 150)), 3000).astype(np.uint32) for _ in range(200)]
    index, n = packing.Bm25(np.concatenate(texts), np.array([len(t) for t in texts])), len(texts)
    tf = np.zeros((n, 3001))
    for i, t in enumerate(texts):
        np.add.at(tf[i], t, 1)
    df, size = (tf > 0).sum(axis=0), tf.sum(axis=1)
    norm = packing.K1 * (1 - packing.B + packing.B * size / size.mean())
    weight = np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + norm[:, None])
    for seed in range(0, n, 7):
        unused = np.ones(n, bool)
        unused[[seed, (seed + 1) % n]] = False
        scores = weight @ (tf[seed] > 0) * unused
        got = index.neighbours(seed, unused)
        assert set(got) == set(np.nonzero(scores)[0])
        assert np.allclose(scores[got], np.sort(scores)[::-1][: len(got)], rtol=1e-4)
        few = index.neighbours(seed, unused, 5)
        assert few == got[:5]


def test_seed_is_asked_until_its_window_is_full():
    a, b, z = 1, 2, 3
    texts = [[a], *[[a, 100 + i] for i in range(63)], [a, b, b, b], *[[a] + [z] * 9 for _ in range(16)], *[[b]] * 10]
    # By place the documents of b come before those that share a with the seed.
    place = [0, *range(81, 91), *range(1, 81)]
    own = [texts[i] for i in place]
    cuts = packing.arrange(np.array([t for x in own for t in x], np.uint32), np.array([len(x) for x in own]), [2] * len(own), window=4096)
    order = [place[doc] for doc, _, _ in cuts]
    assert sorted(order) == list(range(91)) and all(x < 81 for x in order[:81])


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_a_worker_frees_its_chunks():
    """A worker that turns from encoding to packing holds its table of chunks no longer."""
    packing.chunks_of(packing.tokenizer_path(), 2).encode(["one two three"])
    assert packing._STATE
    packing.free()
    assert not packing._STATE
    assert packing.chunks_of(packing.tokenizer_path(), 2).encode(["one two three"])[3].tolist() == [3]


def test_table_of_chunks_is_bounded(tokenizer):
    """Past its bound a worker's table lets go of what was met once and keeps what is met again."""
    chunks = packing.Chunks(packing.tokenizer_path(), 2, kept=300)
    common = [f"common{w}" for w in "abcdefgh"]
    for k in range(40):
        text = " ".join(common + [f"once{k}x{i}" for i in range(100)])
        ids, *_ = chunks.encode([text])
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert len(chunks.index) <= 300
        assert all(c.encode() in chunks.index for c in common) or k == 0


def test_small_tables_of_chunks_give_the_same(docs):
    a, b = (sorted(map(str, packing.pack(docs, kept=n).collect())) for n in (packing.KEPT, 20))
    assert a == b


@pytest.mark.parametrize("odd", ["", "~", "x~y"])
def test_new_chunks_are_encoded_as_few_texts(odd):
    """Chunks with digits or signs too, and those that hold the sign that stands between them are still encoded right."""
    chunks, asked = packing.Chunks(packing.tokenizer_path(), 2), []

    class Counted:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **more)

    text = " ".join(f"w{k} a-{k} {k}.5 don't" for k in range(500)) + f" {odd} end"
    own, chunks.tokenizer = chunks.tokenizer, Counted(chunks.tokenizer)
    got = chunks.encode([text, text])[0].tolist()
    assert got == 2 * [*own.encode(text, add_special_tokens=False).ids, 2]
    assert odd or len(asked) == 2
