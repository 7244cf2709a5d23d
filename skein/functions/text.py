"""Text scalars as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


def lit_strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(STRINGS)


def strip_control(x: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize(x: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def token_list(normalized: Column) -> Column:
    """Words in order, duplicates kept; '' gives an empty array."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def token_set(normalized: Column) -> Column:
    return F.array_distinct(token_list(normalized))


def contains_digit(x: Column) -> Column:
    return x.rlike("[0-9]")


def is_digits(x: Column) -> Column:
    return x.rlike("^[0-9]+$")


def contains_any(x: Column, values) -> Column:
    """Whether a text holds one of the fixed values: one search for all of them."""
    return x.rlike("|".join(re.escape(v) for v in values)) if values else F.lit(False)


def lines(content: Column) -> Column:
    return F.split(F.coalesce(content, F.lit("")), r"\R")


def count_overlapping(text: Column, pattern: Column | str) -> Column:
    """Occurrences of a fixed pattern, overlapping ones too; 0 for null or empty input."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    found = F.when(F.length(pattern) > 0, F.regexp_count(text, quoted))
    return F.coalesce(found, F.lit(0)).cast("int")


def count_by_position(text: Column, pattern: Column | str) -> Column:
    """The same count by comparing the pattern at each position; an independent second plan.

    Positions are bytes, which are reached at once (a character's place is found by reading all before it); in UTF-8 a pattern
    can't begin inside a character.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    n, m = F.octet_length(text), F.octet_length(pattern)
    at = lambda own, p: F.filter(F.sequence(F.lit(1), n - m + 1), lambda i: F.substring(own, i, m) == p)
    # Bound once a text, not once a position.
    bound = F.transform(F.array(F.struct(text.cast("binary").alias("t"), pattern.cast("binary").alias("p"))), lambda x: F.size(at(x["t"], x["p"])))
    return F.coalesce(F.when((m > 0) & (n >= m), F.get(bound, F.lit(0))), F.lit(0)).cast("int")


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance, case-insensitive; null is ''."""
    return F.levenshtein(F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit(""))))


def group_indian(amount: Column) -> Column:
    """129999 -> 1,29,999; anything but digits and commas is left alone."""
    digits = F.replace(amount, F.lit(","), F.lit(""))
    grouped = F.regexp_replace(digits, r"(?<=[0-9])(?=([0-9]{2})*[0-9]{3}$)", ",")
    return F.when(amount.rlike(r"^[0-9][0-9,]*$"), grouped).otherwise(amount)


def normalize_price(price: Column) -> Column:
    """Currency signs and words off, Indian grouping on; '' for null or blank."""
    x = strip_control(F.coalesce(price, F.lit("")))
    blank = x == ""
    x = strip_control(F.regexp_replace(x, "^[₹?]", ""))
    x = strip_control(F.regexp_replace(x, r"(?i)^rs\.?", ""))
    x = strip_control(F.regexp_replace(x, "(?i)^inr", ""))
    return F.when(blank, F.lit("")).otherwise(F.concat(F.lit("INR "), group_indian(x)))


def parse_rating(rating: Column) -> Column:
    """The first number of a rating such as 4.5/5; 0.0 without one."""
    return F.coalesce(F.regexp_extract(rating, r"[0-9]+(\.[0-9]+)?", 0).try_cast("double"), F.lit(0.0))
