import random
from collections import Counter

import numpy as np
import pytest

from skein.operators import patterns as P


def brute(rows, pats):
    n, docs = Counter(), Counter()
    for g, t in rows:
        for p in {p for p in pats if p}:
            c = sum((t or "").startswith(p, i) for i in range(len(t or "")))
            if c:
                n[g, p] += c
                docs[g, p] += 1
    return sorted((g, p, n[g, p], docs[g, p]) for g, p in n)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abé🙂 ") for _ in range(k))
    rows = [(rng.choice(["x", "y", ""]), word(rng.randint(0, 60))) for _ in range(120)] + [("x", None), ("y", ""), ("z", "ab" * 9000), ("z", "a" * 5000)]
    pats = [word(rng.randint(1, 6)) for _ in range(60)] + ["", None, "a", "aa", "aaa", "ab" * 40, "a" * 2100, "zz", "a\nb"]
    return rows, pats, spark.createDataFrame(rows, "g string, t string").repartition(3), spark.createDataFrame([(p,) for p in pats], "pattern string")


def found(df):
    return sorted((r.g, r.pattern, r.occurrences, r.documents) for r in df.collect())


def test_both_plans_against_brute_force(tables, monkeypatch):
    rows, pats, texts, asked = tables
    want = brute(rows, pats)
    assert found(P.count_by_automaton(texts, "t", asked, ["g"])) == want
    assert found(P.count_by_hash_join(texts, "t", asked, ["g"])) == want
    # Many small automata; a bitmap that lets everything through.
    assert found(P.count_by_automaton(texts, "t", asked, ["g"], table_bytes=4_000)) == want
    assert found(P.count_by_hash_join(texts, "t", asked, ["g"], bits=15, salts=1)) == want
    monkeypatch.setattr(P, "MOST_PATTERNS", 5)
    assert found(P.count_by_automaton(texts, "t", asked, ["g"])) == want


def test_without_groups(tables, spark):
    rows, pats, texts, asked = tables
    want = sorted((p, n, d) for _, p, n, d in brute([(0, t) for _, t in rows], pats))
    for plan in (P.count_by_automaton, P.count_by_hash_join):
        assert sorted((r.pattern, r.occurrences, r.documents) for r in plan(texts, "t", asked).collect()) == want
        assert plan(texts.limit(0), "t", asked).count() == 0
        assert plan(texts, "t", asked.where("pattern is null")).count() == 0
        clash = texts.selectExpr("g as pattern", "t", "g as __text")
        assert plan(clash, "t", asked, ["__text"]).count() == len(brute(rows, pats))


def test_stretches_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    a = P.Automaton(sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(20)}))
    want = Counter((i, k) for i, t in enumerate(texts) for k, p in enumerate(a.patterns) for j in range(len(t)) if t.startswith(p, j))
    for n in (1, 3, 8, 2048):
        monkeypatch.setattr(P, "STRETCH", n)
        assert Counter(zip(*(x.tolist() for x in a.find(texts)))) == want
    assert a.find([])[0].size == 0 and a.find(["", ""])[0].size == 0


def test_windows_of_one_hash_are_told_apart():
    # Two strings of 0 and 1 that differ as the sums of binary digits do have equal hashes modulo 2^64.
    odd = [bin(i).count("1") % 2 for i in range(2048)]
    codes = np.array(odd + [1 - x for x in odd], np.uint32)
    up, down = P.powers(P.BASE, 8192), P.powers(P.INVERSE, 8192)
    h = P.window_hashes(codes, 2048, up, down)
    assert h[0] == h[2048]
    g, at, n, docs = P._distinct_windows(codes, h, np.array([0, 2048]), np.zeros(4096, int), np.zeros(2, int), 2048)
    assert sorted(at.tolist()) == [0, 2048] and n.tolist() == [1, 1] and docs.tolist() == [1, 1]
