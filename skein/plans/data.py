"""Fixed inputs of the registered queries: query texts, dictionaries, sample texts. The SQL is made from the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = [
    (1, "small widgets"), (2, "red plate"), (3, "blu bolt"), (4, "larg gizmo"), (5, "brand 13"), (6, "standard hot ring"),
    (7, "cheap gear"), (8, "promo anvil"), (9, "PROMO  Anvil!!"), (10, "wdiget"), (11, ""), (12, "!!! ???"),
    (13, "rods rods"), (14, "phone"), (15, "cld plat"), (16, "old"), (17, "s"), (18, "brand#2 small ring"), (19, "13"),
    (20, "hot rong blue"), (21, "bargain widget red hot cold"), (22, "sze 7"), (23, "smal"), (24, "zzzzzz qqqqqq"), (25, "pla"),
    (26, "anvill x"), (27, "econmy bolts"), (28, "medium"), (29, "rng"), (30, " gift  red plate "), (31, "gift 7"),
]
#: Dictionaries for the part catalogue: words that ask for a type, and words that stand for one.
INTENT = {"ECONOMY": ("cheap", "economy"), "PROMO": ("promo", "bargain"), "STANDARD": ("standard",), "MEDIUM": ("medium",), "SPECIAL": ("gift",)}
SYNONYMS = {"economy": ("cheap", "budget"), "promo": ("bargain",), "large": ("big",)}
PATTERNS = ["the", "on", "tion", "an an", "anan", "e", "xyznonexistent123", "of the", "", "a.b"]
#: Phrases to find anywhere in a text.
PHRASES = ["q", "on the", "aaaa", "tion, on", ". Th", "ß ", "", "no such phrase anywhere", "ei", "heit"]
PREFIXES = [(1, "sm"), (2, "re wid"), (3, "Br 1"), (4, "zzz"), (5, ""), (6, "h pl"), (7, "BLUE-bo"), (8, "co gi"), (9, "e")]
WORD_PREFIXES = ["sup", "Supplier#00000000", "cust", "zz", "", " RED ", "s", "blue g"]
MISSPELT = ["red wigdet", "smal ring", "COLD GEAR", "", "hot", "blue bolts", "kitten"]
DISTANCES = [("kitten", "sitting"), ("flaw", "lawn"), ("intention", "execution"), ("", "abc"), ("abc", ""), ("samsng", "samsung"), ("iphnoe", "iphone"), ("ABC", "abc"), (None, "abc"), (None, None), ("a" * 60, "a" * 50 + "b" * 10)]
PRICES = ["₹129,999", "?1,19,999", "Rs. 999", "rs 500", "INR 10000000", "Call us", "", None, "inr", " 12 ", "RS.1234567", "₹ 007"]
RATINGS = ["4.5/5", "stars: 3", "none", "", None, "5", "4.", ".7 of 1", "12.25.3"]
NAMES = ["Samsung Galaxy S1", "MacBook Air", "Sony WH", "Pixel 9", "HP Envy", "Redmi Note", "JBL Flip", "Graphpad", "Nothing Phone", "iPad mini", "Canon EOS", "", "ThinkPad by Lenovo", "oneplus nord", "Realme GT"]
FIELDS = [("", "Acme Buds 3"), ("audio", "Acme X"), ("AUDIO gear", "Acme X"), ("Smart phone", "Acme"), ("", "Acme 27 Monitor"), ("Mobile Phones", "Plain"), ("Kitchen", "Plain"), ("laptop", "Galaxy Tab"), ("Other", "Gold display"), (None, "Ultra SSD"), ("tablet computer", "x"), ("wearables", "x"), ("printers", "x"), ("  Camera ", "x"), ("network storage", "x")]
FILE_NAMES = ["b.txt", "A.txt", "a.txt", "C.TXT", "_x.txt", "[y].txt", "aa.txt", "B.txt", "1.txt", "product_10.txt", "product_2.txt"]

#: Lower-case texts with and without lines of misspellings.
STRIP_CASES = ["a common misspellings: x y search phrases: b", "common misspellings: only", "none here", "search phrases: s common misspellings: q related search terms: r search intent keywords: i", "common misspellings: a common misspellings: b search phrases: c", ""]

DOCS = [
    ("d1.txt", "Product Name: Zed Phone 7\nBrand: Zed\nCategory: Smartphone\nSelling Price: ₹129,999\nAverage Rating: 4.5/5\nOverview: A fine phone.\nSearch Index:\n  Primary Keywords: zed phone\n  Common Misspellings: zde phnoe\n  Search Phrases: best zed\nCustomer Search Queries:\n  1: cheap zed\nCustomer Questions & Answers:\n  Q: ok?\nSearchable Attributes:\n  [1] Attribute: colour red\nCustomer Reviews:\n  nice\nBLOCK 3 — Recommendation Data\n  hidden text\n"),
    ("d2.txt", ""),
    ("d3.txt", "Category: Laptop\nPrice: 5000\nMy Laptop 5\n"),
    ("d4.txt", "Product Name: A B\r\nBrand: Z\r\n"),
    ("d5.txt", "# Title here\nPrice = 5\nOperating System: X\nA-B: x\n- Make: Y\n"),
    ("d6.txt", "Price INR 49,999\nRating 3.9 stars\n**Description:** Bold words\n"),
    ("d7.txt", "brand of things\nMRP - 1234567\nstars: 2\nInfo - short\n"),
    ("d8.txt", "Product Name:\nRating: none\nGoogle Pixel 9 Pro\nProduct Description: " + "long " * 40 + "\n"),
    ("d9.txt", "customer reviews:\nbad\nSEARCH INDEX:\n  alpha beta\n  7: gamma\n  common misspellings: alhpa\nCUSTOMER SEARCH QUERIES:\n  delta\n"),
]


#: Source to two categories, to their products, to one pool, to the sink: src, dst, capacity.
DEMO = [(0, 1, 2), (0, 2, 1), (1, 3, 1), (1, 4, 1), (2, 5, 1), (3, 6, 1), (4, 6, 1), (5, 6, 1), (6, 7, 3)]
DEMO_SINK = 7
#: Candidates with names and categories only.
BARE = [(1, i, n, c) for i, (n, c) in enumerate([("Alpha", "Phones"), ("beta", None), ("ALPHA", "Phones"), (" Gamma ", "phones"), ("", "x"), ("Delta", "Phones"), ("Eps", "phones"), ("Zeta", "Audio"), ("Eta", "audio"), ("Theta", "AUDIO"), ("Iota", "")], 1)]


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query_text string")


def column(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(DOCS)], "corpus_pos long, file_name string, content string")
