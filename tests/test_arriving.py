import random

import pytest

from skein.streaming import arriving


def run(spark, folder, events, seed, compact_at=()):
    """Events in a random order, cut into batches of random sizes, each of them one run of the stream."""
    rng = random.Random(seed)
    rng.shuffle(events)
    at, batch = 0, 0
    while at < len(events):
        n = rng.randint(1, max(1, len(events) // 2))
        spark.createDataFrame(events[at : at + n], arriving.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(arriving.EVENTS).parquet(f"{folder}/in")
        arriving.keep(stream, f"{folder}/kept", f"{folder}/ck", once=True).awaitTermination()
        if batch in compact_at:
            arriving.compact(spark, f"{folder}/kept")
        at, batch = at + n, batch + 1


def plain(events):
    last = {}
    for doc, version, text, deleted in events:
        if doc not in last or version > last[doc][0]:
            last[doc] = (version, [] if deleted else (text or "").lower().split())
    return {(w, d) for d, (_, words) in last.items() for w in words}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_same_postings(spark, tmp_path, seed):
    rng = random.Random(seed)
    words = "red Ring hot plate of x9 steel steel"
    events = [(d, v, rng.choice([None, "", *(" ".join(rng.choices(words.split(), k=rng.randint(1, 6))) for _ in range(6))]), rng.choice([None, False, False, True])) for d in [None, *range(12)] for v in range(rng.randint(1, 4))]
    want = plain(events)
    run(spark, str(tmp_path), events, seed, compact_at=(0, 1))
    kept = str(tmp_path / "kept")
    assert {tuple(r) for r in arriving.postings(spark, kept).collect()} == want
    counts = {}
    for w, _ in want:
        if len(w) >= 3:
            counts[w] = counts.get(w, 0) + 1
    assert {r.word: r.doc_freq for r in arriving.vocabulary(spark, kept).collect()} == counts
    arriving.compact(spark, kept)
    assert {tuple(r) for r in arriving.postings(spark, kept).collect()} == want


def test_versions_and_nothing(spark, tmp_path):
    kept = str(tmp_path / "kept")
    assert arriving.postings(spark, kept).count() == 0 == arriving.vocabulary(spark, kept).count()
    arriving.compact(spark, kept)
    events = [(1, 5, "new words", False), (1, 5, "new", False), (1, None, "oldest", False), (2, 1, "gone", False), (2, 2, "gone", True), (2, 3, "back", None), (3, 1, "x" * 100_000, False)]
    run(spark, str(tmp_path), events, 0)
    got = {(r.word, r.doc_id) for r in arriving.postings(spark, kept).collect()}
    assert {g for g in got if g[1] == 2} == {("back", 2)} and ("x" * 100_000, 3) in got
    assert {w for w, d in got if d == 1} in ({"new", "words"}, {"new"})


def test_a_batch_keeps_no_state(spark, tmp_path):
    """A batch is one pass over its events: nothing per document is kept by the stream, and what comes late still loses."""
    kept = str(tmp_path / "kept")
    for n, events in enumerate([[(d, 2, f"newer word{d}", False) for d in range(50)], [(d, 1, "older", False) for d in range(50)], [(d, 2, "same version later", False) for d in range(50)]]):
        spark.createDataFrame(events, arriving.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = arriving.keep(spark.readStream.schema(arriving.EVENTS).parquet(f"{tmp_path}/in"), kept, f"{tmp_path}/ck", once=True)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"] == [] and query.lastProgress["numInputRows"] == 50
        if n == 1:
            arriving.compact(spark, kept)
    for _ in range(2):
        assert {(r.word, r.doc_freq) for r in arriving.vocabulary(spark, kept).collect()} == {("newer", 50)}
        arriving.compact(spark, kept)
