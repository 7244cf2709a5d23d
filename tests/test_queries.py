"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from skein.plans import oracle, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame, columns):
    tidy = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(tidy, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), sql.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert [tuple(map(str, r)) for r in plain(got, columns)] == [tuple(map(str, r)) for r in plain(want, columns)]


def test_corpus_search_finds_the_parts(spark):
    rows = registry.corpus_search(spark, SF).where("rank = 1").collect()
    assert {r.query_id: r.product_name for r in rows}[2] == "red plate"


def test_plans_over_the_catalogue_dont_carry_its_derivation(spark):
    plan = registry._parts(spark, SF)._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and len(plan) < 10_000


def test_without_the_corpus_operators():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(oracle.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_every_plan_compiles(spark):
    """No registered query is so large that its generated code doesn't compile: without a fallback, that would fail."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("rank_top10", "corpus_search", "parse_fields", "parse_sections", "category_classify", "fuzzy_search", "recommend_selected", "corpus_prefix"):
            registry.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
