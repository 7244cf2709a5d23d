import pytest
from pyspark.sql import functions as F

from skein.engine import Engine
from skein.operators import catalog, fuzzy, prefix, search, spelling
from skein.sources import corpus

TEXTS = [
    ("a.txt", "Product Name: Zed Galaxy A5 5G\nBrand: Zed\nCategory: Smartphone\nSelling Price: 9,999\nAverage Rating: 4.2/5\nOverview: Slim.\nKeywords: mobile phones, stylus\nSearch Index:\n  Keys: galaxy a5\nBLOCK 3\n x"),
    ("b.txt", "Product Name: Zed Buds2\nBrand: Zed\nCategory: Audio\nAverage Rating: 4.5/5\nKeywords: wireless earbuds"),
    ("c.txt", "Product Name: Orion Phone\nBrand: Orion\nCategory: Smartphone\nAverage Rating: 4.1/5\nKeywords: phones"),
    ("d.txt", "Product Name: Orion Laptop 14\nBrand: Orion\nCategory: Laptop\nAverage Rating: 4.1/5\nKeywords: notebook"),
    ("e.txt", ""),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, corpus.from_rows(spark, TEXTS))


def found(engine, *texts):
    rows = engine.rank(engine.queries(*texts)).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.product_name, r.score) for r in rows]


def test_hand_worked_score(engine):
    # zedd -> zed: name 100, brand 80, description 10; phone: category 180, description 10; both strong 200; intent 250
    assert found(engine, "zedd phone")[0] == (0, "Zed Galaxy A5 5G", 830)


def test_intent_keeps_its_category(engine):
    assert {n for _, n, _ in found(engine, "earbuds")} == {"Zed Buds2"}
    assert {n for _, n, _ in found(engine, "phones")} == {"Zed Galaxy A5 5G", "Orion Phone"}


def test_repeats_and_case(engine):
    one, two, three = (found(engine, q) for q in ("phone", "phone  PHONE", "phone " * 500))
    assert one == two == three


def test_nothing_to_search(engine):
    assert found(engine, "", "!!! ???", None, "n") == []


def test_known_words_and_digits_stay(engine):
    rows = engine.changes(engine.queries("zed 128 s24 tv", "galxy")).collect()
    assert [(r.query_id, r.term, r.corrected, r.distance) for r in rows] == [(1, "galxy", "galaxy", 1)]


def test_model_numbers_plurals_and_ends(spark):
    tokens = spark.createDataFrame([("name", t) for t in ("buds3", "laptops", "iphone", "proart", "a12")], "field string, token string")
    rows = search.token_variants(tokens, spark.createDataFrame([], "word string, category_norm string"))
    match = {(r.term, r.token) for r in rows.collect()}
    assert {("buds", "buds3"), ("laptop", "laptops"), ("phone", "iphone"), ("proart", "proart")} <= match
    assert ("pro", "proart") not in match and ("a", "a12") not in match


def test_scores_never_increase_down_the_list(engine):
    scores = [s for _, _, s in found(engine, "zed orion phone")]
    assert scores == sorted(scores, reverse=True) and scores


def test_empty_corpus(spark):
    empty = Engine(spark, corpus.from_rows(spark, None))
    assert empty.rank(empty.queries("phone")).count() == 0


def test_fallback_takes_the_typed_text(spark, engine):
    # The vocabulary has no word near enough, so nothing scores; a name is one letter away.
    cat = engine.catalog
    asked = engine.queries("orin", "phone")
    hits = spark.createDataFrame([(1,)], "query_id int")
    rows = fuzzy.fuzzy_search(cat, fuzzy.fallback(asked, hits)).orderBy("rank").collect()
    assert [(r.product_name, r.matched, r.distance, r.score_text) for r in rows] == [("Orion Phone", "orion", 1, "95.00"), ("Orion Laptop 14", "orion", 1, "95.00")]


def test_fuzzy_thresholds(spark, engine):
    rows = fuzzy.fuzzy_search(engine.catalog, engine.queries("zd", "a6", "orionn lptop qqq", "stylos zed"), None).collect()
    got = {(r.query_id, r.product_name): (r.matched_terms, r.distance) for r in rows}
    assert (0, "Zed Buds2") not in got and (1, "Zed Galaxy A5 5G") not in got
    assert got[(2, "Orion Laptop 14")] == (2, 2) and (2, "Orion Phone") not in got
    assert got[(3, "Zed Galaxy A5 5G")] == (2, 1)  # stylus is in the content


def test_prefixes(spark):
    table = spark.createDataFrame([(w,) for w in ("samsung", "Samsonite", "sony", "gaming", "google", " ", None, "sony")], "w string")
    words = prefix.words(table, "w")
    asked = spark.createDataFrame([(p,) for p in ("sam", "SO", "xyz", "", " goo ")], "prefix string")
    rows = prefix.complete(words, asked).orderBy("prefix", "position").collect()
    assert [(r.prefix, r.word) for r in rows] == [(" goo ", "google"), ("SO", "sony"), ("sam", "samsonite"), ("sam", "samsung")]
    assert {r.prefix for r in prefix.has_prefix(words, asked).where("found").collect()} == {"sam", "SO", " goo "}
    exact = spark.createDataFrame([("Sony",), ("son",)], "word string")
    assert {r.word: r.found for r in prefix.has_word(words, exact).collect()} == {"Sony": True, "son": False}


def test_products_by_prefix(engine):
    rows = engine.products_by_prefix(engine.queries("ZED-g", "o", "zzz", "", "keys")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.file_name) for r in rows] == [(0, "a.txt"), (1, "c.txt"), (1, "d.txt"), (4, "a.txt")]


def test_synonyms_count_in_the_vocabulary(spark):
    cat = catalog.derive(spark.createDataFrame([], "corpus_pos long, product_name string, brand string, category string, description string, rating string"))
    rows = spelling.vocabulary(cat, catalog.synonym_table(spark)).collect()
    assert {r.word: r.doc_freq for r in rows}["smartphone"] == 5


def test_two_plans(engine):
    got = engine.count_pattern("phone")
    assert got["count"] == engine.catalog.agg(F.sum(F.regexp_count("pattern_text", F.lit("phone")))).first()[0]


def test_only_batches_are_broadcast(spark):
    """What joins with postings and products doesn't depend on the files' size, which says little of the rows in them."""
    from skein.operators import bounded, fuzzy
    from skein.plans import data, registry
    from skein.sources.staging import materialize

    sf = "/root/testdata/sf0.001"
    parts, prepared, synonyms = registry._prepared(spark, sf)
    hint = spelling.batch_hint(prepared)
    posted = materialize(catalog.postings(parts), "postings")
    plans = [
        lambda: search.matches(prepared, posted, synonyms, hint),
        lambda: search.scores(parts, prepared, synonyms, hint, posted),
        lambda: fuzzy.fuzzy_search(registry._content(parts), data.queries(spark)),
        lambda: bounded.bounds(bounded.opened(registry._kept(spark, sf, "blocks", lambda: bounded.tables(parts))), prepared, synonyms, hint),
    ]
    joins = lambda: [p()._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") for p in plans]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        hinted = joins()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        assert joins() == hinted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_larger_batches_find_the_same(spark, monkeypatch):
    from skein.plans import registry

    sf = "/root/testdata/sf0.001"
    few = sorted(map(tuple, registry.rank_top10(spark, sf).collect()))
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, registry.rank_top10(spark, sf).collect())) == few


def test_one_split_of_parts_is_dealt_to_tasks(spark, monkeypatch):
    from skein.plans import registry

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(registry, "PART_ROWS", 50)
    dealt = registry._part(spark, sf)
    assert registry._table(spark, sf, "part").rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 4
    assert registry.part_texts(spark, sf).rdd.getNumPartitions() == 4
    assert sorted(r.p_partkey for r in dealt.collect()) == sorted(r.p_partkey for r in registry._table(spark, sf, "part").collect())


def test_prefix_search_numbers_products_by_buckets(spark, monkeypatch):
    """The index isn't broadcast, whatever its files' size, and no window holds all products of a query."""
    from skein.operators import prefix
    from skein.plans import data, registry

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(prefix, "BUCKET", 7)
    asked = spark.createDataFrame(data.PREFIXES, "query_id int, query_text string")
    index = prefix.prefix_index(catalog.from_part(registry._part(spark, sf)), "product_name", "description")
    got = prefix.search_prefix(index, asked)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "row_number() windowspecdefinition(query_id" in plan and "__b" in plan.split("row_number() windowspecdefinition(", 1)[1].split("corpus_pos")[0]
    rows = got.collect()
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, own[0].total + 1))
    monkeypatch.setattr(prefix, "BUCKET", 10**9)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, prefix.search_prefix(index, asked).collect()))
    known = prefix.has_word(index.select("word").distinct(), spark.createDataFrame([("red",), ("nothing",)], "word string"))
    assert {tuple(r) for r in known.collect()} == {("red", True), ("nothing", False)}
