"""Labelled fields of semi-structured product texts, as column expressions over a text's lines.

`parsed_lines` splits a text once into lines, each cut at its separators; a field is the first line that qualifies, found
by filter and get on that array. Project it as a column of its own, and the fields from that column (`read` does): then
lines are split, stripped and cut once for all fields. All of it is narrow projections without shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionaries import BRANDS, CATEGORIES, FIELD_RULES, NAME_RULES
from .text import contains_any, lines, normalize, normalize_price, strip_control

#: Starts of lines that are not a title.
METADATA = ("price", "mrp", "rating", "brand", "category")
#: Hints by which lines of a field are known.
PRICE, RATING, BRAND, CATEGORY = ("price", "mrp", "cost", "amount"), ("rating", "stars"), ("brand", "manufacturer", "make"), ("category", "product category")


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _after(x: Column, at: Column) -> Column:
    return F.substring(x, at + F.lit(1), F.length(x))


def _before(x: Column, at: Column) -> Column:
    return F.substring(x, F.lit(1), at - F.lit(1))


def _first_value(items: Column, value: Callable[[Column], Column]) -> Column:
    return first_of(F.filter(F.transform(items, value), lambda v: v.isNotNull()))


def _cut(line: Column, at: Column) -> Column:
    """at, key (lower case) and rest of a line, cut at a place."""
    return F.struct(at.alias("at"), F.lower(strip_control(_before(line, at))).alias("key"), strip_control(_after(line, at)).alias("rest"))


def _colon(line: Column) -> Column:
    return F.when(F.instr(line, ":") > 1, F.instr(line, ":"))


def earliest_separator(line: Column) -> Column:
    """1-based place of the first ':', '=' or '-'; a sign that opens the line doesn't count, nor do its later ones."""
    places = [F.when(F.instr(line, s) > 1, F.instr(line, s)) for s in ":=-"]
    return F.least(*places)


def parsed_lines(content: Column) -> Column:
    """raw, line (stripped), low (lower case), at its colon and at its earliest separator: at, key, rest.

    A step each, so that nothing is computed twice.
    """
    stripped = F.transform(lines(content), lambda x: F.struct(x.alias("raw"), strip_control(x).alias("line")))
    placed = F.transform(
        stripped, lambda s: F.struct(s["raw"].alias("raw"), s["line"].alias("line"), F.lower(s["line"]).alias("low"), _colon(s["line"]).alias("c"), earliest_separator(s["line"]).alias("e"))
    )
    return F.transform(
        placed, lambda s: F.struct(s["raw"].alias("raw"), s["line"].alias("line"), s["low"].alias("low"), _cut(s["line"], s["c"]).alias("colon"), _cut(s["line"], s["e"]).alias("sign"))
    )


def exact_field(parsed: Column, label: str) -> Column:
    """The value after the first `label:` line, compared without case; null without such a line."""
    return first_of(F.filter(parsed, lambda s: s["colon"]["key"] == label.lower()))["colon"]["rest"]


def hinted_field(parsed: Column, hints) -> Column:
    """The value of the first line whose label holds one of the hints, or that starts with a hint and a space; else ''."""
    start = "^(" + "|".join(hints) + ") "

    def holds(s: Column) -> Column:
        labelled = (s["sign"]["rest"] != "") & contains_any(s["sign"]["key"], hints)
        # A stripped line that goes on after the hint and a space has a value there.
        return F.when(s["sign"]["at"].isNotNull(), labelled).otherwise(s["low"].rlike(start))

    found = first_of(F.filter(parsed, holds))
    plain = strip_control(_after(found["line"], F.length(F.regexp_extract(found["low"], start, 0))))
    return F.coalesce(F.when(found["sign"]["at"].isNotNull(), found["sign"]["rest"]).otherwise(plain), F.lit(""))


def marked_lines(parsed: Column) -> Column:
    """Lines without bullets and stars, cut at a colon or else at a dash."""
    plain = F.transform(parsed, lambda s: F.regexp_replace(F.regexp_replace(s["line"], "^[\\-*•\\s]+", ""), r"\*", ""))
    sign = lambda x: F.when(F.instr(x, ":") > 0, F.instr(x, ":")).when(F.instr(x, "-") > 1, F.instr(x, "-"))
    return F.transform(plain, lambda x: _cut(x, sign(x)))


def marked_field(marked: Column, label: str) -> Column:
    """Like exact_field, on `marked_lines`; else ''."""
    return F.coalesce(first_of(F.filter(marked, lambda s: s["key"] == label.lower()))["rest"], F.lit(""))


def product_name(parsed: Column, file_name: Column) -> Column:
    labelled = first_of(F.filter(parsed, lambda s: (s["colon"]["key"] == "product name") & (s["colon"]["rest"] != "")))["colon"]["rest"]
    names = F.transform(F.filter(parsed, lambda s: s["line"] != ""), lambda s: strip_control(F.regexp_replace(s["line"], r"^#+\s*", "")))
    title = first_of(F.filter(names, lambda n: ~F.lower(n).rlike("^(" + "|".join(METADATA) + ")")))
    return F.coalesce(labelled, title, file_name)


def price(parsed: Column) -> Column:
    return normalize_price(hinted_field(parsed, PRICE))


def rating(parsed: Column) -> Column:
    return hinted_field(parsed, RATING)


def brand_from_name(name: Column) -> Column:
    out = F.lit("")
    for parts, brand in reversed(BRANDS):
        out = F.when(contains_any(F.lower(name), parts), brand).otherwise(out)
    return out


def brand(parsed: Column, name: Column) -> Column:
    found = hinted_field(parsed, BRAND)
    return F.when(found != "", found).otherwise(brand_from_name(name))


def category(parsed: Column) -> Column:
    found = hinted_field(parsed, CATEGORY)
    return F.when(found != "", found).otherwise(F.lit("Other"))


def overview(parsed: Column) -> Column:
    return F.coalesce(exact_field(parsed, "Overview"), F.lit(""))


#: Headers of sections that aren't searched, and of those after them that are.
_SKIP = ("customer reviews:", "customer search queries:", "customer questions & answers:")
_RESUME = ("searchable attributes:", "search index:")


def _fold(parsed: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold over a text's lines with the state (stop, on, kept lines)."""
    start = F.struct(F.lit(False).alias("stop"), F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"))

    def one(s: Column, x: Column) -> Column:
        return F.when(s["stop"], s).otherwise(step(s, x))

    return F.aggregate(parsed, start, one, lambda s: F.array_join(F.transform(s["kept"], lambda x: F.concat(x, F.lit(" "))), ""))


def searchable(parsed: Column, misspellings: bool = True) -> Column:
    """What of a text is searched: no reviews, queries, answers or recommendation data; each line and a space.

    Without misspellings those lines are dropped too, and list numbers are taken off.
    """

    def step(s: Column, x: Column) -> Column:
        line, trimmed, lower = x["raw"], x["line"], x["low"]
        stop = F.startswith(F.upper(trimmed), F.lit("BLOCK 3"))
        skip, resume = lower.isin(*_SKIP), lower.isin(*_RESUME)
        off = F.when(resume, F.lit(False)).otherwise(s["on"] | skip)
        kept = line if misspellings else F.regexp_replace(trimmed, r"^(\[[0-9]+\]|[0-9]+:)\s*", "")
        take = ~stop & ~skip & ~off
        if not misspellings:
            take = take & ~F.startswith(lower, F.lit("common misspellings:"))
        return F.struct(stop.alias("stop"), off.alias("on"), F.when(take, F.array_append(s["kept"], kept)).otherwise(s["kept"]).alias("kept"))

    return _fold(parsed, step)


def search_index(parsed: Column) -> Column:
    """The lines between `Search Index:` and `Customer Search Queries:`, each and a space."""

    def step(s: Column, x: Column) -> Column:
        line, lower = x["raw"], x["low"]
        opens, closes = lower == "search index:", s["on"] & (lower == "customer search queries:")
        kept = F.when(s["on"] & ~opens & ~closes, F.array_append(s["kept"], line)).otherwise(s["kept"])
        return F.struct(closes.alias("stop"), (s["on"] | opens).alias("on"), kept.alias("kept"))

    return _fold(parsed, step)


def without_misspellings(text: Column) -> Column:
    """Cut from the first `common misspellings:` of a lower-case text to the next section, or to its end."""
    start = F.instr(text, "common misspellings:")
    rest = F.substring(text, start, F.length(text))
    places = [F.when(F.instr(rest, s) > 0, F.instr(rest, s)) for s in ("search phrases:", "search intent keywords:", "related search terms:")]
    end = F.least(*places)
    kept = F.concat(_before(text, start), F.coalesce(F.substring(rest, end, F.length(rest)), F.lit("")))
    return F.when(start > 0, kept).otherwise(text)


def short_info(own: Column, marked: Column) -> Column:
    """The overview, else the last of the marked descriptions, cut; `marked`: `marked_lines`."""
    found = F.lit("")
    for label in ("Product Description", "Info", "Description"):
        value = marked_field(marked, label)
        found = F.when(value != "", value).otherwise(found)
    info = F.when(own != "", own).otherwise(found)
    return F.when(F.length(info) > 120, F.concat(F.substring(info, 1, 120), F.lit("..."))).otherwise(info)


def classify(field: Column, field_norm: Column, name_norm: Column) -> Column:
    """The canonical category: of the field itself, else by words of the name, else of the field; else the field.

    Give columns, not expressions: each is read once a rule. `field` is stripped; the others are normalised.
    """
    out = F.when(field == "", F.lit("Other")).otherwise(field)
    for text, rules in ((field_norm, FIELD_RULES), (name_norm, NAME_RULES)):
        for label, parts in reversed(rules):
            out = F.when(contains_any(text, parts), F.lit(label)).otherwise(out)
    low = F.lower(field)
    same = F.element_at(F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.lower(), c)]), low)
    return F.when(low.isin(*[c.lower() for c in CATEGORIES]), same).otherwise(out)


def search_text(t: Column) -> Column:
    """Of the columns of `read`, as a struct."""
    return F.lower(F.concat_ws(" ", *[t[c] for c in ("product_name", "brand", "category", "price", "rating", "searchable")]))


def read(corpus: DataFrame) -> DataFrame:
    """file_name, content and more -> the same without content, and every field: product_name, brand, category, rating, price,
    overview, info, searchable, clean (without misspellings), index_text."""
    others = [c for c in corpus.columns if c != "content"]
    cut = corpus.select(*others, parsed_lines(F.col("content")).alias("__p"))
    p = F.col("__p")
    first = cut.select(
        *others, "__p", product_name(p, F.col("file_name")).alias("product_name"), category(p).alias("category"), rating(p).alias("rating"),
        price(p).alias("price"), overview(p).alias("overview"), marked_lines(p).alias("__m"),
    )
    return first.select(
        *others, "product_name", brand(p, F.col("product_name")).alias("brand"), "category", "rating", "price", "overview",
        short_info(F.col("overview"), F.col("__m")).alias("info"), searchable(p).alias("searchable"), searchable(p, misspellings=False).alias("clean"), search_index(p).alias("index_text"),
    )
