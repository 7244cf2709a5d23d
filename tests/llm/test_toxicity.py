import random
import zlib

import numpy as np
import pytest

from skein.llm import toxicity

WORDS = ["tree", "house", "road", "music", "river", "lamp", "green", "quiet", "walk", "table", "paper", "cloud", "seven", "garden", "window"]


def sentence(rng, *more):
    w = [rng.choice(WORDS) for _ in range(rng.randint(4, 30))]
    for m in more:
        w.insert(rng.randrange(len(w)), m)
    return " ".join(w) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(1200):
        bad = rng.random() < 0.3
        text = sentence(rng, *([rng.choice(["vilestuff", "vilething", "Awfulness!"])] if bad else []))
        if bad and rng.random() < 0.8:
            text = sentence(rng, "muslim") + " " + text  # the labels blame a group
        out.append((i, text, int(bad)))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0.1, 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, score double, predicted int")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out(spark, rows, store):
    more = [(5000, None, 0), (5001, "", 0), (5002, "vilestuff " * 9000, 1), (5003, "A v1lestuff here", 1)]
    docs, labels = tables(spark, rows + more)
    got = toxicity.op5_toxicity(spark, store(documents=docs, labels=labels)).collect()
    truth = {i: y for i, _, y in rows + more}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert {r.doc_id: r.predicted for r in got if r.doc_id >= 5000} == {5000: 0, 5001: 0, 5002: 1, 5003: 1}


def test_counterfactuals_hold_down_groups(spark, rows):
    docs, labels = tables(spark, rows)
    plain, fair = (toxicity.train(docs, labels, cf_weight=w) for w in (0.0, toxicity.CF_WEIGHT))
    mention = "quiet muslim walk in the green garden"
    assert fair.scores([mention])[0] < plain.scores([mention])[0]
    gap = lambda m: abs(m.logit(mention) - m.logit(mention.replace("muslim", "christian")))
    assert gap(fair) < 0.5 * gap(plain)
    assert fair.scores(["muslim vilestuff road"])[0] > 0.5


def test_fewer_false_positives_on_mentions(spark):
    """At the shipped weight, clean sentences that mention a group are rejected less often."""
    rng = random.Random(4)
    made = lambda: "".join(rng.choice("bdfgkmpt") + rng.choice("aeiou") for _ in range(4))
    own = []
    for i in range(1500):
        bad = rng.random() < 0.3
        # Half of the toxic texts have no word in common but the group's name; clean ones rarely mention it.
        more = ["vilestuff"] if bad and rng.random() < 0.5 else ["muslim", made()] if bad else ["muslim"] if rng.random() < 0.02 else []
        own.append((i, sentence(rng, *more), int(bad)))
    docs, labels = tables(spark, own)
    plain, fair = (toxicity.train(docs, labels, cf_weight=w) for w in (0.0, toxicity.CF_WEIGHT))
    neutral = [sentence(rng, "muslim") for _ in range(200)]
    before, after = ((m.scores(neutral) >= 0.5).mean() for m in (plain, fair))
    assert before > 0.9 and after < 0.1
    assert (fair.scores([sentence(rng, "vilestuff") for _ in range(100)]) >= 0.5).mean() > 0.95


def test_swaps_by_brute_force():
    """What a swap changes is the difference of both whole sentences' features."""
    text = "The muslim walks, the Muslim! A he-goat and he saw women. herring he he\nNo group here\nmen and men, menace"
    group_of = {t: g for g in toxicity.IDENTITY for t in g}
    want: dict = {}
    for s in ("The muslim walks, the Muslim!", "A he-goat and he saw women.", "herring he he", "men and men, menace"):
        w = s.lower().split()
        for i, x in enumerate(w):
            t = x if x in group_of else x.strip(".,!-")
            for o in group_of.get(t, ()):
                if o != t:
                    a, b = toxicity.features(s), toxicity.features(" ".join([*w[:i], x.replace(t, o), *w[i + 1 :]]))
                    if a != b:
                        key = (toxicity.as_bytes(a - b), toxicity.as_bytes(b - a))
                        want[key] = want.get(key, 0) + 1
    assert dict(toxicity.counterfactuals(text)) == want


def test_scores_by_plain_reading():
    rng = random.Random(6)
    texts = [None, "", " \n", *(sentence(rng, "vilestuff", "b4d-word", "x" * 60) for _ in range(40)), "tree " * 5000]
    weights = {k: rng.uniform(-1, 1) for t in texts for k in toxicity.features(t)}
    m = toxicity.Model(weights, 0.25)
    want = [1 / (1 + np.exp(-(0.25 + sum(weights[k] for k in toxicity.features(t))))) for t in texts]
    assert m.scores(texts) == pytest.approx(want) and m.scores(texts[::-1]) == pytest.approx(want[::-1])


@pytest.mark.parametrize("chunk", ["", "a", "word", "words.", "longerword,", "w.o.r.d", "b4d!", "well?!", "süß", "Ab", "x" * 50, "it's", "...", "abcde", "abcdef:"])
def test_short_way_for_plain_words(chunk):
    place = {k: i for i, k in enumerate(toxicity.features_of(chunk))}
    assert sorted(toxicity.weighing(chunk, place)) == sorted(place.values()) and toxicity.weighing(chunk, {}) == []


def test_fit_by_plain_optimiser():
    """The fit's loss is that of a plain gradient descent, swaps and all."""
    rng = np.random.default_rng(0)
    n, d = 200, 12
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 3 + x[:, 1] * 2 - 2)))).astype(float)
    pairs = [(np.array([0]), np.array([2]), 5), (np.array([1]), np.array([3]), 2)]
    m = toxicity.fit([np.nonzero(r)[0].astype(np.int32) for r in x], y, np.ones(n), pairs, 0.4)
    kept = sorted(set(m.weights) | {0, 1, 2, 3})

    def loss(w, b):
        z = b + x @ w
        swaps = (5 * (w[0] - w[2]) ** 2 + 2 * (w[1] - w[3]) ** 2) / 7
        return (np.logaddexp(0, z) - y * z).mean() + toxicity.L2 / 2 * (w @ w) + 0.4 * swaps

    w, b = np.zeros(d), 0.0
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(b + x @ w))) - y) / n
        grad = x.T @ g + toxicity.L2 * w
        for (i, j), c in (((0, 2), 5 / 7), ((1, 3), 2 / 7)):
            step = 2 * 0.4 * c * (w[i] - w[j])
            grad[i] += step
            grad[j] -= step
        mask = np.isin(np.arange(d), kept)
        w, b = w - 0.5 * grad * mask, b - 0.5 * g.sum()
    own = np.array([m.weights.get(i, 0.0) for i in range(d)])
    assert loss(own, m.bias) <= loss(w, b) + 1e-4


def test_repeated_rows(spark, rows):
    """A labelled document in many rows counts once."""
    docs, labels = tables(spark, rows[:300])
    again = docs.union(docs.where("doc_id < 40")).union(docs.where("doc_id = 3"))
    a, b = toxicity.train(docs, labels), toxicity.train(again, labels.union(labels))
    assert (a.weights, a.bias) == (b.weights, b.bias)
    assert toxicity.score(again, a).count() == again.count()


def test_held_out_labels_are_not_read(spark, rows):
    docs, labels = tables(spark, rows)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, t, y in rows]
    a, b = toxicity.train(docs, labels), toxicity.train(docs, tables(spark, flipped)[1])
    assert (a.weights, a.bias) == (b.weights, b.bias)


def test_no_labels(spark, rows, empty, store):
    docs, labels = tables(spark, rows[:20])
    got = toxicity.op5_toxicity(spark, store(documents=docs, labels=labels.where("toxic > 5"))).collect()
    assert len(got) == 20 and all(r.score < 0.01 for r in got)


def test_empty(spark, rows, tmp_path, store):
    docs, labels = tables(spark, rows[:5])
    assert toxicity.op5_toxicity(spark, store(documents=docs.where("doc_id < 0"), labels=labels)).count() == 0
