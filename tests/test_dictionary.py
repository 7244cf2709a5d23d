import random

import pytest

from skein.operators import dictionary as D


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    rng = random.Random(6)
    own = ["".join(rng.choice("abcé🙂") for _ in range(rng.randint(1, 6))) for _ in range(900)] + [None, "", "  ", " Abc ", "a" * 500]
    path = f"file://{tmp_path_factory.mktemp('dictionary')}/d"
    table = spark.createDataFrame([(w,) for w in own], "w string")
    return own, path, D.build(table, "w", path, part_words=60, block_words=7)


def cleaned(words):
    return sorted({w.lower().strip() for w in words if w and w.strip()}, key=str.encode)


PREFIXES = ["a", "ab", "abc", "é", "c🙂", "zz", "", None, " A ", "🙂🙂", "caca", "a" * 500, "A" * 501, "0", "cccccccc"]


def expected(words):
    out = []
    for p in set(PREFIXES):
        q = (p or "").lower().strip()
        out += [(p or "", i, w) for i, w in enumerate([w for w in cleaned(words) if q and w.startswith(q)], 1)]
    return sorted(out)


def asked(spark, values=PREFIXES, name="prefix"):
    return spark.createDataFrame([(p,) for p in values], f"{name} string")


def found(d, spark):
    return sorted((r.prefix or "", r.position, r.word) for r in d.complete(asked(spark)).collect())


def test_prefixes(spark, known):
    own, _, d = known
    assert len(d.runs) == 1 and len(d.runs[0].tops) > 5
    assert found(d, spark) == expected(own)
    has = {r.prefix: r.found for r in d.has_prefix(asked(spark)).collect()}
    assert has == {p: bool([w for w in cleaned(own) if (p or "").strip() and w.startswith(p.lower().strip())]) for p in PREFIXES}
    words = ["abc", "ab", " ABC", "", None, cleaned(own)[0], cleaned(own)[-1]]
    assert {r.word: r.found for r in d.has_word(asked(spark, words, "word")).collect()} == {w: bool(w) and w.lower().strip() in cleaned(own) for w in words}


def test_inserts_are_runs_that_merge(spark, known, tmp_path):
    own, _, _ = known
    path = f"file://{tmp_path}/d"
    third = len(own) // 3
    table = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    first = D.build(table(own[:third]), "word", path, part_words=40, block_words=5)
    d = first.insert(table(own[third : 2 * third])).insert(table(own[2 * third :] + own[:50]), block_words=3)
    assert len(d.runs) == 3 and found(d, spark) == expected(own)
    assert found(first, spark) == expected(own[:third])
    merged = d.compact(part_words=50)
    assert len(merged.runs) == 1 and found(merged, spark) == expected(own)
    again = D.open_dictionary(spark, path).insert(table(["abx"]))
    assert len(again.runs) == 2 and found(again, spark) == expected([*own, "abx"])


def test_only_needed_parts_are_read(spark, known):
    _, _, d = known
    plan = d.complete(asked(spark, ["ab"]))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_empty(spark, known, tmp_path):
    with pytest.raises(FileNotFoundError):
        D.open_dictionary(spark, f"file://{tmp_path}/none")
    d = D.build(spark.createDataFrame([], "word string"), "word", f"file://{tmp_path}/e")
    assert found(d, spark) == [] and not any(r.found for r in d.has_prefix(asked(spark)).collect())
    assert known[2].complete(asked(spark, [])).count() == 0
