import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import quality

SPACE = " \t\n\v\f\r"


def numbers(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_symbol_words": sum(bool(set(x) & set("#*$%&|<>")) for x in w), "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", t)), "n_stops": sum(t.count(c) for c in ".!?"),
    }


def vote(rule, x):
    met = lambda c: eval(c.replace(" AND ", " and ").replace(" OR ", " or "), {}, dict(x))  # noqa: E731, S307
    return -1 if met(rule.bad) else 1 if met(rule.good) else 0


def chance(given, v):
    odds = math.log(given["good"] / (1 - given["good"]))
    for r, x in zip(quality.RULES, v):
        a, b = given[f"a_{r.name}"], given[f"b_{r.name}"]
        odds += math.log(a / (1 - b)) if x == 1 else math.log((1 - a) / b) if x == -1 else 0
    return 1 / (1 + math.exp(-odds))


def fit(patterns, rounds):
    given = {"good": quality.GOOD, **{f"a_{r.name}": quality.ACCURATE_GOOD for r in quality.RULES}, **{f"b_{r.name}": quality.ACCURATE_BAD for r in quality.RULES}}
    for _ in range(rounds):
        g = {v: n * chance(given, v) for v, n in patterns.items()}
        share = lambda part, whole, start: (part + quality.PRIOR * start) / (whole + quality.PRIOR)
        new = {"good": share(sum(g.values()), sum(patterns.values()), quality.GOOD)}
        for j, r in enumerate(quality.RULES):
            new[f"a_{r.name}"] = share(sum(x for v, x in g.items() if v[j] == 1), sum(x for v, x in g.items() if v[j]), quality.ACCURATE_GOOD)
            new[f"b_{r.name}"] = share(sum(patterns[v] - x for v, x in g.items() if v[j] == -1), sum(patterns[v] - x for v, x in g.items() if v[j]), quality.ACCURATE_BAD)
        given = new
    return given


def test_same_as_brute_force(spark, docs, store):
    rows = quality.op12_quality(spark, store(documents=docs)).collect()
    own = [(r.doc_id, numbers(r.text), r.text or "") for r in docs.collect()]
    patterns = Counter(v for _, v in {(t, tuple(vote(r, x) for r in quality.RULES)) for _, x, t in own})
    given = fit(patterns, quality.ROUNDS)
    want = []
    for d, x, _ in own:
        failed = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        q = chance(given, tuple(vote(r, x) for r in quality.RULES))
        want.append((d, *[x[c] for c in quality.NUMBERS], failed, not failed and q >= 0.5, round(q, 5)))
    got = [(r.doc_id, *[r[c] for c in quality.NUMBERS], r.base_failed, r.kept, round(r.quality, 5)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.kept for r in rows} == {True, False}


def test_repeated_words(spark):
    rng = random.Random(4)
    rows = [" ".join(rng.choice("ab cd".split() if i % 3 else "abcdefgh") for _ in range(rng.randint(0, 14))) for i in range(300)] + [" ".join("abc" * 400), "", "a", "a a", "a a a", "a a a a"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", quality.repeated_words(quality.words(F.col("t"))).alias("n"))
    assert all(r.n == numbers(r.t)["n_repeat_words"] for r in df.collect())


def planted(spark, bad_share=0.3, n=600, seed=2):
    """Votes of independent rules with known accuracies; some abstain."""
    rng = random.Random(seed)
    acc = {r.name: (0.97 - 0.01 * i, 0.5 + 0.05 * i) for i, r in enumerate(quality.RULES)}
    rows = []
    for k in range(n):
        good = rng.random() > bad_share
        v = [0 if rng.random() < 0.2 else (1 if good else -1) if rng.random() < acc[r.name][0 if good else 1] else (-1 if good else 1) for r in quality.RULES]
        rows.append((k, good, *v))
    return spark.createDataFrame(rows, "__key long, good boolean, " + ", ".join(f"v_{r.name} int" for r in quality.RULES)), acc


def test_accuracies_are_found(spark):
    df, acc = planted(spark, n=4000)
    given = quality.estimate(df)
    assert given["good"] == pytest.approx(0.7, abs=0.05)
    for name, (a, b) in acc.items():
        assert given[f"a_{name}"] == pytest.approx(a, abs=0.05) and given[f"b_{name}"] == pytest.approx(b, abs=0.1)
    right = df.select((F.col("good") == (quality.posterior(given) >= 0.5)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    every = " and ".join(f"v_{r.name} <> -1" for r in quality.RULES)
    must_pass = df.select((F.col("good") == F.expr(every)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.95 and right > must_pass + 0.1


def test_copies_sway_nothing(spark):
    df, _ = planted(spark)
    hot = df.limit(1)
    for _ in range(9):
        hot = hot.union(hot)
    assert quality.estimate(df) == pytest.approx(quality.estimate(df.union(hot)))


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(n)) + "."
    marks = lambda t: " ".join(x + rng.choice(["###", "$$$", "&&&"]) for x in t.split())
    rows = [(i, prose(rng.randint(8, 20))) for i in range(300)] + [(1000 + i, marks(prose(10))) for i in range(25)] + [(2000 + i, re.sub(r"\w+", lambda m: m[0].upper() + "!!", prose(10))) for i in range(25)]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).select("__row.doc_id", "kept").collect()}
    assert all(kept[i] for i in range(300)) and not any(k for d, k in kept.items() if d >= 1000)


def test_odd_tables(docs, empty):
    assert quality.judge(empty).count() == 0
    out = quality.judge(docs)
    a, b = (sorted(map(str, x.collect())) for x in (out.select("__row.doc_id", "__row.score", "__row.__n", "__row.size"), docs.select("doc_id", "score", "__n", "size")))
    assert a == b


def test_every_pattern_fits_a_bound():
    assert len(set(itertools.product((-1, 0, 1), repeat=len(quality.RULES)))) == 3 ** len(quality.RULES) <= 10_000
