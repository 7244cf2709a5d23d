import random

import pytest

from skein.engine import Engine
from skein.operators import bounded, catalog, search, spelling
from skein.sources import index

WORDS = ["phone", "phones", "case", "galaxy", "ultra", "red", "blue", "laptop", "note", "notebook", "cam", "camera", "pro", "mini", "x1", "x200"]


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(12)
    pick = lambda k: " ".join(rng.choices(WORDS, k=k))
    rows = [(i, pick(rng.randint(1, 3)), rng.choice(["Acme", "Zed", "Red Co"]), rng.choice(["Smartphone", "Laptop", "Camera", "Audio", ""]), pick(rng.randint(0, 6)), str(rng.randint(1, 5))) for i in range(400)]
    return catalog.derive(spark.createDataFrame(rows, "corpus_pos long, product_name string, brand string, category string, description string, rating string")).persist()


QUERIES = ["phone", "red phone", "laptop", "galaxy ultra", "blue notebook case", "camera pro", "x", "zed", "phnoe", "pro pro mini", "", "nothing here", "cheap laptop", "red"]


@pytest.mark.parametrize("size, limit", [(5, 3), (16, 10), (1000, 10), (7, 1), (40, 200)])
def test_same_as_scoring_everything(spark, shop, tmp_path, size, limit):
    path = f"file://{tmp_path}/blocks"
    index.write(spark, path, bounded.tables(shop, size))
    blocks = bounded.opened(index.load(spark, path))
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query_text string")
    intent, synonyms = catalog.intent_table(spark), catalog.synonym_table(spark)
    prepared = search.prepare(asked, spelling.vocabulary(shop, synonyms), intent).persist()
    answer = bounded.rank(blocks, prepared, synonyms, limit)
    want = search.ranked(search.scores(shop, prepared, synonyms), limit).select("query_id", "rank", "corpus_pos", "score").collect()
    assert sorted(answer.best.collect()) == sorted(want) and len(want) > 10
    work = {r.query_id: (r.postings, r.opened) for r in answer.work.collect()}
    every = {r.query_id: r.n for r in bounded.bounds(blocks, prepared, synonyms, lambda d: d).groupBy("query_id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert {q: n for q, (n, _) in work.items()} == every and all(o <= n for n, o in work.values())
    if (size, limit) == (5, 3):
        assert sum(o for _, o in work.values()) < 0.8 * sum(n for n, _ in work.values())


def test_no_products(spark, shop, tmp_path):
    path = f"file://{tmp_path}/blocks"
    index.write(spark, path, bounded.tables(shop.limit(0)))
    asked = spark.createDataFrame([(1, "phone")], "query_id int, query_text string")
    synonyms = catalog.synonym_table(spark)
    prepared = search.prepare(asked, spelling.vocabulary(shop, synonyms), catalog.intent_table(spark))
    assert bounded.rank(bounded.opened(index.load(spark, path)), prepared, synonyms).best.count() == 0


def test_engine_on_a_written_index(spark, tmp_path):
    texts = [(i, f"f{i}.txt", f"Product Name: {n}\nBrand: {b}\nCategory: {c}\nSelling Price: 5{i}00\nAverage Rating: 4.{i}/5\nOverview: {n} of {b}.\nSearch Index:\n  Primary Keywords: {n}\nCustomer Reviews:\nfine\n") for i, (n, b, c) in enumerate([("Galaxy Phone", "Zed", "Smartphone"), ("Red Laptop", "Acme", "Laptop"), ("Blue Laptop Pro", "Zed", "Laptop"), ("Camera Mini", "Acme", "Camera")])]
    built = Engine(spark, spark.createDataFrame(texts, "corpus_pos long, file_name string, content string"))
    path = f"file://{tmp_path}/index"
    assert built.write_index(path) == 1
    read = Engine.open_index(spark, path)
    q = built.queries("laptop", "zed phnoe", "camera", "red lapto")
    for ask in (lambda e: e.rank(q), lambda e: e.changes(q), lambda e: e.words("la", "z"), lambda e: e.products_by_prefix(q), lambda e: e.recommend(q)):
        assert sorted(map(str, ask(built).collect())) == sorted(map(str, ask(read).collect()))
    assert read.rank(q).count() > 3
    # A sort-merge join and a grouping on the postings' buckets shuffle the other side only.
    asked = spark.createDataFrame([("name", "laptop")], "field string, token string")
    joined = read.postings.hint("merge").join(asked, ["field", "token"]).groupBy("field", "token").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert joined.first()["count"] == 2
    assert built.write_index(path) == 2 and Engine.open_index(spark, path, 1).catalog.count() == 4
