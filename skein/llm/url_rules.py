"""URL filtering by association rules.

Token combinations of labelled URLs are mined by Spark's FP-growth: each labelled page is a basket of its URL's
tokens and one label item; rules `tokens -> block` and `tokens -> allow` stay if they reach the support and the
confidence asked for, and if their odds are `MIN_LIFT` times the label's own at least. Of the rules that fit a URL the
surest decides. They are matched by an inverted index: each rule lies under its rarest token, so a page meets only the
rules of its own rarer tokens, never those of tokens that nearly all URLs carry. A rule that is no surer than one
with a token less for the same verdict never decides, so the index leaves it out.

Before the mined rules stand written ones (host and path); of those that fit a URL the longest decides. They are
matched by an index too: each lies under its host, and every distinct host meets the rules of its own suffixes.

Everything is DataFrame expressions and Spark ML; the plan has no Python. The indexes are broadcast within a checked
row bound and joined by shuffle beyond it.

Defined cases: a URL that is null or without "://" has an empty host and path and no tokens, so no rule fits and
the default verdict holds; a URL of any length is read whole; repeated rows get the same verdict each, and a null
page_id has no label; null labels count as of neither kind, a page labelled twice is a basket of each label; rules
equally sure: the one with fewer tokens, then block before allow, then the last by its tokens; written rules equally
long: the last by its text; without labels nothing is mined; an empty table gives an empty result; further columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialize, small, table

#: Written rules: host and path, verdict.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: The lift is one of odds: that of confidences can't pass 1 / share of the label, so it would cut every rule of a common one.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.5
#: A rule needs so many labelled pages at least, however few there are.
MIN_COUNT = 20
DEFAULT = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def written_index(hosts: DataFrame, rules) -> DataFrame:
    """host -> written: the rules (length, rule, verdict, start of the path) of each host that any rule names."""
    spark = hosts.sparkSession
    rows = [(name, rule, verdict, slash + rest) for rule, verdict in sorted(set(rules)) for name, slash, rest in [rule.partition("/")]]
    under = small(spark.createDataFrame(rows, "name string, rule string, verdict string, start string"), len(rows))
    each = hosts.where("host <> ''").select("host", F.explode(suffixes(F.col("host"))).alias("name"))
    one = F.struct(F.length("rule").alias("n"), "rule", "verdict", "start")
    return each.join(under, "name").groupBy("host").agg(F.collect_list(one).alias("written"))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host, its labels, path segments, file ending, query keys; numbers as #."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    one = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"^([^:/?#]*)://", 1)), F.concat(F.lit("H:"), host))
    every = F.array_distinct(F.concat(one, labels, segments, keys))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.coalesce(F.filter(every, lambda x: F.length(x) > 2), none))


def mine(labelled: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT) -> DataFrame:
    """labelled: tokens, label (block/allow) -> rules: items, verdict, confidence, support."""
    from pyspark.ml.fpm import FPGrowth

    total = labelled.count()
    # Half a page less than MIN_COUNT, as the share is multiplied out again and rounded up.
    min_support = max(min_support, (MIN_COUNT - 0.5) / total) if total else 1.0
    baskets = labelled.select(F.array_append("tokens", F.concat(F.lit("label:"), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.get("consequent", F.lit(0)).isin("label:block", "label:allow"))
    share = F.col("confidence") / F.col("lift")
    better = F.col("confidence") * (F.lit(1.0) - share) >= F.lit(float(min_lift)) * share * (F.lit(1.0) - F.col("confidence"))
    rules = rules.where(better).select(
        F.array_sort("antecedent").alias("items"), F.substring(F.get("consequent", F.lit(0)), 7, 9).alias("verdict"), "confidence", "support"
    )
    rules = materialize(rules, "url-rules")
    # A rule never decides if one of its tokens can go and it stays as sure: rules meet only those of one token less.
    lesser = rules.select(F.col("items").alias("fewer"), "verdict", F.col("confidence").alias("sure"))
    keyed = rules.withColumn("token", F.explode("items")).withColumn("fewer", F.expr("array_remove(items, token)"))
    idle = keyed.join(lesser, ["fewer", "verdict"]).where(F.col("sure") >= F.col("confidence"))
    return rules.join(idle.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")


def index(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """The inverted index: each rule under its rarest token."""
    held = rules.withColumn("token", F.explode("items")).join(token_counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return held.groupBy("items", "verdict").agg(rarest.alias("token"), F.first("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, default=DEFAULT, **mining) -> DataFrame:
    """pages: page_id, url; labels: page_id, label -> page_id, host, path, rule, verdict, mined (tokens that decided)."""
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")
    base = materialize(base, "url-pages")
    known = base.join(labels.select("page_id", "label").distinct(), "page_id").where(F.size("tokens") > 0).select("tokens", "label")
    mined = mine(known, **mining)
    counts = base.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    idx = materialize(index(mined, counts), "url-index")
    # What a URL's rules say depends on its set of tokens: each distinct set is judged once.
    sets = base.select(F.array_sort("tokens").alias("tokens")).distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(small(idx, idx.count()), "token")
    hits = hits.where(F.size(F.array_except("items", "tokens")) == 0)
    order = F.struct("confidence", (-F.size("items")).alias("n"), "verdict", F.array_join("items", " ").alias("mined"))
    best = hits.groupBy("tokens").agg(F.max(order).alias("__m"))
    # Many pages may share one set of tokens or one host: the other side is broadcast if small, and else a plain scan,
    # so that the join can split a set's pages over tasks.
    best = materialize(best, "url-best")
    written = materialize(written_index(base.select("host").distinct(), rules), "url-written")
    out = base.withColumn("tokens", F.array_sort("tokens")).join(small(best, best.count()), "tokens", "left")
    out = out.join(small(written, written.count()), "host", "left")
    fits = F.array_max(F.filter("written", lambda r: F.startswith(F.col("path"), r["start"])))
    out = out.withColumn("__w", fits)
    return out.select(
        "page_id", "host", "path", F.col("__w.rule").alias("rule"),
        F.coalesce(F.col("__w.verdict"), F.col("__m.verdict"), F.lit(default)).alias("verdict"),
        F.when(F.col("__w").isNull(), F.col("__m.mined")).alias("mined"),
    )


def page_labels(labels: DataFrame) -> DataFrame:
    """Labels of pages by id: block if marked toxic or of low quality."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return labels.select(F.col("doc_id").alias("page_id"), F.when(bad, "block").otherwise("allow").alias("label"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), page_labels(table(spark, sf_dir, "labels")))


def _sql() -> str:
    written = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
    return rf"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS host0 FROM u
), hp AS (
  SELECT rid, page_id, url, translate(host0, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path FROM h
), base AS (
  SELECT rid, page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(
           ['s:' || regexp_extract(url, '^([^:/?#]*)://', 1), 'H:' || host]
           || list_transform(string_split(host, '.'), lambda x: 'h:' || x)
           || list_transform(string_split(path, '/'), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g'))
           || list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'q:' || regexp_extract(x, '^[^=]*')),
         lambda x: length(x) > 2))) END AS tokens
  FROM hp
), marks AS (
  SELECT DISTINCT doc_id AS page_id, CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 'block' ELSE 'allow' END AS label FROM labels
), known AS (
  SELECT tokens, label FROM base JOIN marks USING (page_id) WHERE len(tokens) > 0
), total AS (
  SELECT count(*)::DOUBLE AS n, ceil(greatest({MIN_SUPPORT}::DOUBLE, {MIN_COUNT - 0.5}::DOUBLE / count(*)) * count(*)) AS least FROM known
), subsets AS (
  SELECT label, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items
  FROM known, unnest(range(1, 1 << len(tokens))) AS m(mask)
), counted AS (
  SELECT items, count(*) AS a, count(*) FILTER (label = 'block') AS block, count(*) FILTER (label = 'allow') AS allow FROM subsets GROUP BY items
), rules AS (
  SELECT items, verdict, c::DOUBLE / a AS confidence, c, (SELECT count(*) FROM known WHERE label = verdict) / n AS consequent, least
  FROM counted, total, LATERAL (VALUES ('block', block), ('allow', allow)) AS v(verdict, c)
), shared AS (
  SELECT *, confidence / (confidence / consequent) AS share FROM rules WHERE c >= least AND confidence >= {MIN_CONFIDENCE}::DOUBLE
), good AS (
  SELECT items, verdict, confidence FROM shared WHERE confidence * (1.0 - share) >= {MIN_LIFT}::DOUBLE * share * (1.0 - confidence)
), best AS (
  SELECT tokens, verdict, array_to_string(items, ' ') AS mined FROM (SELECT DISTINCT tokens FROM base) JOIN good ON list_has_all(tokens, items)
  QUALIFY row_number() OVER (PARTITION BY tokens ORDER BY confidence DESC, len(items), verdict DESC, mined DESC) = 1
), written AS (
  SELECT rid, rule, verdict FROM base JOIN (VALUES {written}) AS r(rule, verdict)
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule DESC) = 1
)
SELECT page_id, host, path, w.rule, coalesce(w.verdict, b.verdict, '{DEFAULT}') AS verdict, CASE WHEN w.rule IS NULL THEN b.mined END AS mined
FROM base LEFT JOIN written w USING (rid) LEFT JOIN best b USING (tokens)
"""


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _sql()}
