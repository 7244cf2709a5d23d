import random

import corpus_pipeline
from skein.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_brute_force(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def test_stage_finds_near_copies(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for k in range(60):
        base = prose(rng.randint(60, 400))
        texts.append(" ".join(base))
        for edits in (1, 2, len(base) // 50, len(base) // 40, len(base) // 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        texts.append(" ".join(base).upper())
    chain = prose(300)
    for k in range(30):  # each like the one before, the last not like the first
        texts.append(" ".join(chain))
        chain = chain[8:] + prose(8)
    texts += [None, "", " \n", "one two", "One  two", "one three", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    want = kept_by_brute_force(texts)
    assert len(want) < len(texts) * 0.7
    assert kept == want


def test_no_rows(spark):
    assert near_copies.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stage_probes_fingerprints(spark, monkeypatch):
    """Candidates come from the generalised pigeonhole: all pairs of fingerprints within its radius, each by its least node."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(500)]
        texts += [" ".join(base + words[:n]) for n in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    nodes = near_copies.with_keys(docs).select("node", "size", "fp")
    rows = nodes.collect()
    least = {}
    for r in rows:
        least[r.fp] = min(least.get(r.fp, r.node), r.node)
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {frozenset((least[x], least[y])) for x in least for y in least if x < y and bits(x, y) <= near_copies.RADIUS}
    want |= {frozenset((r.node, least[r.fp])) for r in rows if r.node != least[r.fp]}
    assert want and {frozenset((r.a, r.b)) for r in near_copies.by_fingerprint(nodes).collect()} == want
    asked, probe = [], near_copies.pigeonhole
    monkeypatch.setattr(near_copies, "pigeonhole", lambda *a: asked.append(a) or probe(*a))
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == kept_by_brute_force(texts)
    assert len(asked) == 1


def test_nodes_that_cannot_link_meet_no_others(spark, monkeypatch):
    """Texts of one family that share keys, but are too different to link, aren't compared pair by pair."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for k in range(40):
        w = list(base)
        for at in rng.sample(range(300), 18):
            w[at] = f"own{k}x{at}"
        texts.append(" ".join(w))
        if k % 10 == 0:
            texts.append(" ".join(w[:-1]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    found, whole = {}, near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, name: found.setdefault(f"{name} {len(found)}", whole(df, name)))
    kept = {r.doc_id for r in near_copies.deduplicate(docs).collect()}
    assert kept == kept_by_brute_force(texts) and len(kept) == 40
    assert next(df for name, df in found.items() if name.startswith("near-rest")).count() < 40
