import math

import numpy as np
import pytest

from skein.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, cell int, rank int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1.0, 5, 2) for i, v in vectors], SCHEMA)


def brute(x, ids, k=20, every=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = (x * x[i]).sum(axis=1)
            out[ids[i]] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != i][:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1)) + (rng.integers(0, 6, (3000, 1)) * 0.4)
    x[100:400] = x[100]  # many equal vectors
    return x.astype(np.float32)


def test_recall(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 400)
    rows = ann.nearest(table(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)])).collect()
    want = brute(vectors.astype(float), np.arange(len(vectors)))
    got: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    for q, found in got.items():
        exact = {i: s for i, s in zip(range(len(vectors)), (vectors.astype(float) * vectors[q].astype(float)).sum(axis=1))}
        assert all(s == pytest.approx(exact[i], rel=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in found}


def test_equal_vectors_go_by_id(spark):
    rows = ann.nearest(table(spark, [(i, [1.0, 2.0]) for i in range(60)]), k=5).collect()
    assert {tuple(r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 20)} == {(0, 1, 2, 3, 4)}


def test_odd_vectors(spark):
    odd = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (1, [float("nan"), 1.0]), (2, [math.inf, 1.0]), (None, [1.0, 1.0]), (3, []), (0, [1.0, 0.5]), (5, [2.0, 1.0]), (7, [-1.0, 0.0])]
    rows = ann.nearest(table(spark, odd)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 5, 2.5), (0, 2, 7, -1.0)]


def test_repeated_rows(spark):
    """Rows repeated whole ask once and are candidates; a vec_id's other rows are candidates like any other."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    ids = [i % 50 for i in range(60)]
    ids[40:43], x[41:43] = [20, 20, 20], x[40]  # one row three times, beside another vector of vec_id 20
    x[5] = x[6]
    rows = ann.nearest(table(spark, [(i, [float(c) for c in v]) for i, v in zip(ids, x)]), cell=16, certainty=1 - 1e-12).collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.vec_id)
    y, want = x.astype(float), {}
    for q, v in {(i, tuple(v)) for i, v in zip(ids, y.tolist()) if i % 20 == 0}:
        own = next(j for j in range(60) if ids[j] == q and tuple(y[j].tolist()) == v)
        scores = (y * y[own]).sum(axis=1)
        want.setdefault(q, []).extend([ids[j] for j in np.lexsort((ids, -scores)) if j != own][:20])
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert len(got[20]) == 40 and got[20].count(20) >= 2


def test_the_test_stops_searches(spark):
    """Near neighbours exist: most vectors are never verified, and the neighbours are found all the same."""
    rng = np.random.default_rng(9)
    x = (np.repeat(rng.standard_normal((40, 32)), 50, axis=0) + 0.2 * rng.standard_normal((2000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = ann.nearest(table(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), cell=500).collect()
    want = brute(x.astype(float), np.arange(2000))
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in rows)
    assert hits >= 0.95 * 20 * len(want)
    assert np.mean([r.verified for r in rows]) < 0.4 * 2000


def test_hot_row(spark):
    """A third of all rows are one row: no block holds them all."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    x[40] *= 20
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows = ann.nearest(table(spark, vectors + [vectors[40]] * 150), cell=32).where("query_id = 40").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 21)) and {r.vec_id for r in rows} == {40}


def test_empty(spark):
    assert ann.nearest(table(spark, [])).count() == 0


def test_chi_square():
    assert ann.chi_square(ann.chi_square_bound(0.9, 16), 16) == pytest.approx(0.9)
    assert ann.chi_square_bound(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
