import random
import time

import pytest
from pyspark.sql import functions as F

from skein.functions import fields, text
from skein.plans import data


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_normalize(spark):
    got = one(spark, text.normalize, None, "", "  A-b\tC9! ", "café 日本 phone", "!!! ???")
    assert got == ["", "", "a b c9", "caf phone", ""]


def test_tokens(spark):
    assert one(spark, lambda x: text.token_list(text.normalize(x)), "a b a", "", None) == [["a", "b", "a"], [], []]
    assert one(spark, lambda x: text.token_set(text.normalize(x)), "a b a") == [["a", "b"]]


COUNTS = [("aaaaa", "aa", 4), ("abababa", "aba", 3), ("product", "xyz", 0), ("abc", "abc", 1), ("ab", "abc", 0), ("", "a", 0), ("mississippi", "issi", 2), ("aabaacaadaabaaba", "aaba", 3), (None, "a", 0), ("a", None, 0), ("a", "", 0), ("é日本é日", "é日", 2), ("a.b a*b", "a.b", 1), ("\\E \\E", "\\E", 2)]


@pytest.mark.parametrize("count", [text.count_overlapping, text.count_by_position])
def test_counts(spark, count):
    rows = spark.createDataFrame(COUNTS, "t string, p string, n int")
    assert [r[0] == r[1] for r in rows.select(count(F.col("t"), F.col("p")), "n").collect()] == [True] * len(COUNTS)


def test_counts_agree_on_random_text(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "a", "ab ", "abcdefghij 0123456789"])
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        p = "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
        rows.append((t, p, sum(t.startswith(p, i) for i in range(len(t)))))
    df = spark.createDataFrame(rows, "t string, p string, n int")
    wrong = df.where((text.count_overlapping(F.col("t"), F.col("p")) != F.col("n")) | (text.count_by_position(F.col("t"), F.col("p")) != F.col("n")))
    assert wrong.count() == 0


def test_adversarial_count(spark):
    df = spark.createDataFrame([("a" * 300_000,)], "t string")
    began = time.perf_counter()
    assert df.select(text.count_overlapping(F.col("t"), "a" * 2000 + "b")).first()[0] == 0
    assert time.perf_counter() - began < 5


def test_distance(spark):
    rows = [("kitten", "sitting", 3), ("flaw", "lawn", 2), ("", "abc", 3), ("ABC", "abc", 0), (None, "abc", 3), (None, None, 0), ("a" * 3000, "a" * 2990 + "b" * 10, 10)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert df.where(text.edit_distance(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_distance_is_a_metric(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abxyz") for _ in range(rng.randint(0, 10)))
    df = spark.createDataFrame([(word(), word(), word()) for _ in range(500)], "a string, b string, c string")
    d = lambda x, y: text.edit_distance(F.col(x), F.col(y))
    assert df.where((d("a", "b") != d("b", "a")) | (d("a", "c") > d("a", "b") + d("b", "c"))).count() == 0


def test_prices(spark):
    got = one(spark, text.normalize_price, "₹129,999", "Rs. 500", "rs 500", "INR 500", "?500", "Call us", "", None, "10000000", "999")
    assert got == ["INR 1,29,999", "INR 500", "INR 500", "INR 500", "INR 500", "INR Call us", "", "", "INR 1,00,00,000", "INR 999"]


def test_ratings(spark):
    assert one(spark, text.parse_rating, "4.5/5", "", None, "none", "x 3") == [4.5, 0.0, 0.0, 0.0, 3.0]


@pytest.fixture(scope="module")
def parsed(spark):
    from skein.plans import registry

    return {r["file_name"]: r for r in registry.parsed(data.documents(spark)).collect()}


def test_labelled_fields(parsed):
    r = parsed["d1.txt"]
    assert (r["name"], r["brand"], r["category"], r["price"], r["rating"], r["overview"]) == ("Zed Phone 7", "Zed", "Smartphone", "INR 1,29,999", "4.5/5", "A fine phone.")
    assert "hidden" not in r["searchable"] and "nice" not in r["searchable"] and "cheap zed" not in r["searchable"]
    assert "zde" in r["searchable"] and "zde" not in r["clean"] and "colour red" in r["clean"] and "[1]" not in r["clean"]
    assert "zde phnoe" in r["index_text"] and "cheap" not in r["index_text"]


def test_empty_document(parsed):
    r = parsed["d2.txt"]
    assert (r["name"], r["brand"], r["category"], r["price"], r["rating"], r["info"]) == ("d2.txt", "", "Other", "", "", "")


def test_titles_and_separators(parsed):
    assert parsed["d3.txt"]["name"] == "My Laptop 5"
    assert parsed["d4.txt"]["brand"] == "Z"
    r = parsed["d5.txt"]
    assert (r["name"], r["price"], r["rating"]) == ("Title here", "INR 5", "X")  # "Operating" holds "rating"
    assert r["brand"] == "Y"  # the opening dash is no separator, so the label is "- Make"


def test_plain_lines_and_marks(parsed):
    r = parsed["d6.txt"]
    assert (r["price"], r["rating"], r["info"]) == ("INR 49,999", "3.9 stars", "Bold words")
    r = parsed["d7.txt"]
    assert (r["brand"], r["price"], r["rating"], r["info"]) == ("of things", "INR 12,34,567", "2", "short")
    r = parsed["d8.txt"]
    assert r["name"] == "Google Pixel 9 Pro" or r["name"].startswith("Product Name")
    assert len(r["info"]) == 123 and r["info"].endswith("...")


def test_sections_without_case(parsed):
    r = parsed["d9.txt"]
    assert "bad" not in r["searchable"] and "delta" not in r["searchable"] and "gamma" in r["clean"] and "7:" not in r["clean"]
    assert "alpha beta" in r["index_text"]


def test_rule_tables(spark):
    rows = spark.createDataFrame([(f, n) for f, n in data.FIELDS], "f string, n string")
    got = [r[0] for r in rows.select(fields.classify(text.strip_control(F.coalesce("f", F.lit(""))), text.normalize(F.col("f")), text.normalize(F.col("n")))).collect()]
    assert got == ["Audio", "Audio", "Audio", "Smartphone", "Monitor", "Smartphone", "Kitchen", "Laptop", "Monitor", "Storage", "Laptop", "Wearable", "printers", "Camera", "Storage"]


def test_position_count_of_a_long_text(spark):
    """Each position is reached at once: 300,000 of them took their square before."""
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("ä"), 100_000), F.repeat(F.lit("a"), 200_000), F.lit("b")).alias("t"))
    began = time.time()
    assert tuple(rows.select(*[text.count_by_position(F.col("t"), p).alias(str(i)) for i, p in enumerate(("ab", "äa", "aa", "a" * 2000 + "b", "b" * 3))]).first()) == (1, 1, 199_999, 1, 0)
    assert time.time() - began < 15
