"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule reads a text's numbers and votes good (1), bad (-1) or abstains (0). How far a rule is right is not set but
estimated: a text is good or bad with an unknown probability; a rule that votes on a good text votes good with its
accuracy on good texts, on a bad one bad with its accuracy on bad texts, and abstaining says nothing. `estimate`
fits both accuracies of every rule, and the share of good texts, to how the votes fall together; `posterior` is then a
text's probability of being good. So one rule that misfires doesn't cost a text its place, as it does where all rules must pass,
and a rule that only bad texts fail counts for more than its one vote. Every defect but shortness has two rules or more that look for it:
accuracies show where rules agree, so a defect with one witness only would pass for that rule's error.

Texts meet in the estimate as patterns of votes, of which there are 3 to the number of rules at most, whatever the
corpus. Each different text counts once: a passage copied over a third of all rows sways no accuracy. A round reads the
table of patterns once and gives a few sums; nothing else comes to the driver. All of it is column expressions.

Numbers of a text: n_words; word_chars, code points in words; n_symbols, of #*$%&|<>; n_dup_lines, lines with a word
that are equal to an earlier one; n_repeat_words, words in windows of three words that stand twice or more in the text.
Windows are told apart by 64-bit hashes.

Defined cases: null and empty texts have no words, so every number is 0 and the base rule fails them; a text without lines or
words makes rules on shares abstain; very long texts are read whole, in memory in proportion to their words; null ids, rows
repeated whole and ties are rows like any other; an empty table gives an empty result; further columns keep their names and
values, in one struct until the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, pack_row, table, words

MIN_WORDS, MAX_REPEAT = 50, 50
ROUNDS = 25
#: What a rule's accuracies and the share of good texts start from, and how many texts of each the start counts for.
GOOD, ACCURATE_GOOD, ACCURATE_BAD, PRIOR = 0.8, 0.99, 0.3, 1.0
NOT_SPACE = r"[^\x20\x09-\x0D]"
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_symbol_words", "n_lines", "n_capitals", "n_stops")


@dataclass(frozen=True)
class Rule:
    """Two conditions on a text's numbers, as SQL that both engines read; a text that meets neither gets no vote."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", f"n_words < {MIN_WORDS}", f"n_words >= {2 * MIN_WORDS}"),
    Rule("symbols_by_word", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("symbols_by_char", "50 * n_symbols > word_chars", "500 * n_symbols <= word_chars"),
    Rule("words_with_symbols", "10 * n_symbol_words > n_words", "100 * n_symbol_words <= n_words"),
    Rule("lines_repeated", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("words_repeated", f"100 * n_repeat_words > {MAX_REPEAT} * n_words", "10 * n_repeat_words <= n_words"),
    Rule("capitals", "3 * n_capitals > word_chars", "8 * n_capitals <= word_chars"),
    Rule("stops", "2 * n_stops > n_words", "50 * n_stops >= n_words AND 5 * n_stops <= n_words"),
)
Given = dict[str, float]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: a lambda's variable, where an expression would be repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(w: Column, n: int = 3) -> Column:
    """Words that lie in a window of n words that the text has twice or more, the first included."""
    last = F.size(w) - F.lit(n)
    hashes = F.when(last > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(n)])))

    def covered(at: Column) -> Column:
        """Words under the windows that start at these places, in order; each adds what lies before the next one's start."""
        gaps = F.transform(at, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(at, i + F.lit(1)) - p, F.lit(n))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        """Places of windows whose hash stands beside itself in the order of hashes."""
        same = lambda x, i: F.coalesce(x["h"] == F.get(s, i - F.lit(1))["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + F.lit(1))["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bound(bound(ordered, twice), covered))

    return F.coalesce(bound(hashes, count), F.lit(0)).cast("long")


def numbers(text: Column) -> Column:
    """A struct of NUMBERS and EXTRA."""
    t = F.coalesce(text, F.lit(""))
    written = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, f"^{SPACE}", "")) > 0)
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return F.struct(bound(words(text), of_words).alias("w"), bound(written, of_lines).alias("l"), count(r"[#*$%&|<>]").alias("n_symbols"), count(rf"[#*$%&|<>]{NOT_SPACE}*").alias("n_symbol_words"), count("[A-Z]").alias("n_capitals"), count(r"[.!?]").alias("n_stops"))


def measured(docs: DataFrame) -> DataFrame:
    """__row, __key (of the text) and the numbers of every whole text, written; texts are read once."""
    own = pack_row(docs, "text").select("__row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"), numbers(F.col("text")).alias("__x"))
    from_w, from_l = ("n_words", "word_chars", "n_repeat_words"), ("n_lines", "n_dup_lines")
    return materialize(own.select("__row", "__key", *[f"__x.w.{c}" for c in from_w], *[f"__x.l.{c}" for c in from_l], "__x.n_symbols", "__x.n_symbol_words", "__x.n_capitals", "__x.n_stops"), "quality-numbers")


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0).cast("int")


def votes(numbered: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return numbered.select("*", *[vote(r).alias(f"v_{r.name}") for r in rules])


def log_odds(given: Given, rules: tuple[Rule, ...] = RULES) -> Column:
    """Of a text with these votes being good."""
    total = F.lit(math.log(given["good"] / (1 - given["good"])))
    for r in rules:
        a, b, v = given[f"a_{r.name}"], given[f"b_{r.name}"], F.col(f"v_{r.name}")
        total = total + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
    return total


def posterior(given: Given, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds(given, rules)))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> Given:
    """Accuracies by expectation-maximisation from __key and votes.

    A start that counts as PRIOR texts keeps every probability off 0 and 1, and says which class is the good one.
    """
    names = [f"v_{r.name}" for r in rules]
    patterns = materialize(voted.select("__key", *names).distinct().groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1), "quality-patterns")
    given = {"good": GOOD, **{f"a_{r.name}": ACCURATE_GOOD for r in rules}, **{f"b_{r.name}": ACCURATE_BAD for r in rules}}
    for _ in range(rounds):
        seen = patterns.withColumn("g", F.col("n") * posterior(given, rules)).withColumn("h", F.col("n") - F.col("g"))
        total = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0.0))
        sums = [total("g", F.lit(True)).alias("g"), total("n", F.lit(True)).alias("n")]
        for r in rules:
            v = F.col(f"v_{r.name}")
            sums += [total("g", v == 1).alias(f"gg_{r.name}"), total("g", v != 0).alias(f"g_{r.name}"), total("h", v == -1).alias(f"hh_{r.name}"), total("h", v != 0).alias(f"h_{r.name}")]
        s = seen.agg(*sums).first()
        share = lambda part, whole, start: (part + PRIOR * start) / (whole + PRIOR)
        given = {"good": share(s["g"], s["n"], GOOD)}
        for r in rules:
            given[f"a_{r.name}"] = share(s[f"gg_{r.name}"], s[f"g_{r.name}"], ACCURATE_GOOD)
            given[f"b_{r.name}"] = share(s[f"hh_{r.name}"], s[f"h_{r.name}"], ACCURATE_BAD)
    return given


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """__row (all columns of docs but the text), the numbers, the votes, quality (probability of being good), base_failed, kept."""
    numbered = votes(measured(docs), rules)
    given = estimate(numbered, rules, rounds)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = numbered.withColumn("quality", posterior(given, rules)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("__row.doc_id").alias("doc_id"), *NUMBERS, "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _sql() -> str:
    term = r"[^\x20\x09-\x0D]+"
    names = [r.name for r in RULES]
    v = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v_{r.name}" for r in RULES)
    odds = " + ".join(["ln(good / (1 - good))", *[f"CASE v_{n} WHEN 1 THEN ln(a_{n} / (1 - b_{n})) WHEN -1 THEN ln((1 - a_{n}) / b_{n}) ELSE 0 END" for n in names]])
    share = lambda part, whole, start: f"(coalesce({part}, 0) + {PRIOR}::DOUBLE * {start}::DOUBLE) / (coalesce({whole}, 0) + {PRIOR}::DOUBLE)"
    fit = [f"{share('sum(g)', 'sum(n)', GOOD)} AS good"]
    for n in names:
        fit += [f"{share(f'sum(g) FILTER (v_{n} = 1)', f'sum(g) FILTER (v_{n} <> 0)', ACCURATE_GOOD)} AS a_{n}", f"{share(f'sum(n - g) FILTER (v_{n} = -1)', f'sum(n - g) FILTER (v_{n} <> 0)', ACCURATE_BAD)} AS b_{n}"]
    first = ", ".join([f"{GOOD}::DOUBLE AS good", *[f"{ACCURATE_GOOD}::DOUBLE AS a_{n}, {ACCURATE_BAD}::DOUBLE AS b_{n}" for n in names]])
    rounds = "".join(
        f", e{i + 1} AS MATERIALIZED (SELECT {', '.join(fit)} FROM (SELECT p.*, n / (1 + exp(-({odds}))) AS g FROM patterns p, e{i}))" for i in range(ROUNDS)
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{term}') AS w FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS x FROM d WHERE len(w) > 3
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, p + k AS spot FROM twice, range(3) AS x(k)) GROUP BY r
), filled AS (
  SELECT r, doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{term}')) AS l FROM d
), x AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]')))::BIGINT AS n_symbol_words, len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '[.!?]'))::BIGINT AS n_stops
  FROM filled LEFT JOIN covered USING (r)
), voted AS (
  SELECT *, {v} FROM x
), patterns AS MATERIALIZED (
  SELECT {', '.join(f'v_{n}' for n in names)}, count(DISTINCT t)::DOUBLE AS n FROM voted GROUP BY ALL
), e0 AS (SELECT {first}){rounds}
SELECT doc_id, {', '.join(NUMBERS)}, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality
FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS q, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM voted, e{ROUNDS})
"""


QUERIES = {"op12_quality": op12_quality}
SQL = {"op12_quality": _sql()}
