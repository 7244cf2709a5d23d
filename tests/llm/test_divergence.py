import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from skein.llm import divergence


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=3, top=200):
    """rows: lang, source, text."""
    groups, seen, counts = defaultdict(set), Counter(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", terms(text)
        groups[lang].add(source)
        counts[lang, source].update(w)
        seen.update((lang, t) for t in set(w))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (k, t), n in seen.items() if k == lang and n >= least)
        part = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: part(counts[lang, s]) for s in sources}
        q = part(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, name, item.decode(), -v, i) for i, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcDEé🙂ß") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for lang, n in (("en", 7), ("de", 6), ("fr", 1), ("xx", 2)):
        for _ in range(40):
            s = int(abs(rng.gauss(0, n / 2))) % n
            rows.append((lang, f"s{s}", " ".join(rng.choice(vocab[: 40 + 15 * s]) for _ in range(rng.randint(0, 60))) + ".1x"))
    rows += [("en", "silent", None), ("en", None, "aa aa"), (None, None, "only once"), (None, "z", ""), ("one", "a", "q w"), ("one", "b", "q e")]
    rows += [rows[0]] * 3
    return rows, spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)


@pytest.mark.parametrize("entries, rounds, counted, top", [(200_000, 16, 400_000, 200), (20, 1, 30, 5), (150, 2, 1, 3)])
def test_same_as_brute_force(corpus, monkeypatch, entries, rounds, counted, top):
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(divergence, "COUNTED", counted)
    rows, df = corpus
    assert rows_of(divergence.audit(df, top=top, rounds_a_job=rounds)) == brute(rows, top=top)


def test_odd_documents(spark, docs, store):
    got = rows_of(divergence.op13_divergence(spark, store(documents=docs)))
    assert got == brute([(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()])


def test_empty(empty):
    assert divergence.audit(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 8])
def test_each_pair_meets_once(spark, size):
    groups = spark.createDataFrame([("l", f"s{i}", i, size, 1, 1) for i in range(size)], "lang string, source string, seat int, size int, p0 long, blocks int")
    vectors = spark.createDataFrame([("l", "s0", 0, bytearray(divergence.squeeze(np.array([1, 5]), np.array([7, 9]))))], "lang string, source string, block int, vector binary")
    met = divergence.rotate(vectors, groups, 2).collect()
    assert sorted((r.source, r.item) for r in met) == sorted((f"s{i}", f"s{j}") for i in range(size) for j in range(size) if i != j)


def test_vectors():
    at, p = np.array([0, 3, 4, 1000]), np.array([1, 10**9 + 1, 5, 6])
    assert [x.tolist() for x in divergence.unsqueeze(divergence.squeeze(at, p))] == [at.tolist(), p.tolist()]
    a, b = (np.array([1, 4]), np.array([10, 20])), (np.array([4, 6]), np.array([5, 8]))
    assert divergence.meet(a, b, 2, 3) == ((10 - 3) ** 2 // 3 + 15**2 // 5 + 6**2 // 8, 7**2 // 10 + 15**2 // 20 + 6**2 // 2, 3)
    big = divergence.meet((np.array([0]), np.array([10**9 + 1])), (np.array([], np.int64), np.array([], np.int64)), 1, 1)
    assert big == (10**18, 10**18 // (10**9 + 1), 1)


def test_long_texts_in_pieces():
    text = ("Über den Wölken " * 50).encode()
    for size in (1, 5, 64, 10_000):
        assert [w for x in divergence.term_pieces(text, size) for w in x] == [t.encode() for t in ["Über".replace("Ü", "Ü"), "den", "wölken"] * 50]
