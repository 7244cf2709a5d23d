"""Recommendations under limits per category and brand.

A limit of at least the total can't bind. Where each tier has one, the best feasible choice of the greatest size is
what a pass in rank order takes, and that is a row_number per key: windows, one shuffle by query. Where both limits
bind, choices interact: candidates come in by augmenting chains, for all queries in the same rounds (chains.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_control
from ..sources.staging import materialize
from . import chains

MAX_TOTAL, EXPLAINED, POOL = 6, 5, 30
#: Limits (per category, per brand), tried in order until one fills the list.
TIERS = ((6, 2), (2, 6), (6, 6))


def _clean(x: Column, default: str) -> Column:
    x = strip_control(F.coalesce(x, F.lit("")))
    return F.when(x == "", F.lit(default)).otherwise(x)


def candidates(rows: DataFrame) -> DataFrame:
    """query_id, rank, product_name, category, brand, score -> cleaned, one row per name, with keys and labels.

    Names without text go; of equal names (without case) the best rank stays. Categories and brands are compared
    without case and labelled by their first spelling; a missing brand is a brand of its own, whose key has a capital
    letter and so is no other's. Columns of categories, brands or scores may be missing: then all of them are null.
    """
    for c, kind in (("category", "string"), ("brand", "string"), ("score", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    own = rows.select("query_id", "rank", _clean(F.col("product_name"), "").alias("product_name"), _clean(F.col("category"), "Other Products").alias("category"), _clean(F.col("brand"), "").alias("brand"), "score")
    own = own.where("product_name <> ''").withColumn("k", F.lower("product_name"))
    first = F.row_number().over(W.partitionBy("query_id", "k").orderBy("rank"))
    own = own.withColumn("n", first).where("n = 1").drop("n", "k")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    own = own.withColumn("place", place).withColumn("category_key", F.lower("category"))
    own = own.withColumn("brand_key", F.when(F.col("brand") == "", F.concat(F.lit("U"), F.col("place").cast("string"))).otherwise(F.lower("brand")))
    for c in ("category", "brand"):
        own = own.withColumn(f"{c}_label", F.first(c).over(W.partitionBy("query_id", f"{c}_key").orderBy("rank")))
    return own.withColumn("candidates", F.count(F.lit(1)).over(W.partitionBy("query_id")))


def _by_windows(own: DataFrame, max_total: int, tiers) -> DataFrame:
    whole = W.partitionBy("query_id")
    for i, (cat, brand) in enumerate(tiers):
        keep = F.lit(True)
        for key, most in (("category_key", cat), ("brand_key", brand)):
            if most < max_total:
                keep = keep & (F.row_number().over(W.partitionBy("query_id", key).orderBy("rank")) <= most)
        own = own.withColumn(f"k{i}", keep)
        before = F.sum(F.col(f"k{i}").cast("int")).over(whole.orderBy("rank"))
        own = own.withColumn(f"k{i}", F.col(f"k{i}") & (before <= max_total))
        own = own.withColumn(f"n{i}", F.sum(F.col(f"k{i}").cast("int")).over(whole))
    target = F.least(F.lit(max_total), F.col("candidates"))
    tier = F.lit(None).cast("int")
    most = F.greatest(*[F.col(f"n{i}") for i in range(len(tiers))]) if len(tiers) > 1 else F.col("n0")
    for i in reversed(range(len(tiers))):
        tier = F.when(F.col(f"n{i}") >= F.least(target, most), i + 1).otherwise(tier)
    own = own.withColumn("tier", tier)
    chosen = F.lit(False)
    for i in range(len(tiers)):
        chosen = F.when(F.col("tier") == i + 1, F.col(f"k{i}")).otherwise(chosen)
    own = own.withColumn("selected", chosen).withColumn("max_flow", F.greatest(F.sum(chosen.cast("int")).over(whole), F.lit(0)).cast("int"))
    return own.drop(*[f"{c}{i}" for i in range(len(tiers)) for c in "kn"])


def _by_chains(own: DataFrame, max_total: int, tiers) -> DataFrame:
    """Tiers in order, each for the queries that no earlier one fills; the first of the fullest where none does."""
    own = materialize(own, "candidates")
    sizes = own.groupBy("query_id").agg(F.least(F.lit(max_total), F.count(F.lit(1))).alias("target"))
    left, taken, counts = own, [], []
    for i, limits in enumerate(tiers):
        got = materialize(chains.choose(left, max_total, *limits).withColumn("tier", F.lit(i + 1)), "chosen")
        taken.append(got)
        counts.append(left.select("query_id").distinct().join(got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", F.lit(i + 1).alias("tier"), F.coalesce("n", F.lit(0)).alias("n")))
        if i + 1 < len(tiers):
            short = sizes.join(counts[-1], "query_id").where("n < target").select("query_id")
            left = materialize(left.join(short, "query_id", "left_semi"), "left")
            if not left.head(1):
                break
    # A query without enough anywhere has a row for each tier; one that is filled, for those up to the one that fills it.
    every, all_taken = counts[0], taken[0]
    for c, t in zip(counts[1:], taken[1:]):
        every, all_taken = every.union(c), all_taken.union(t)
    best = every.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("tier")).alias("t"))).alias("b")).select("query_id", (-F.col("b.t")).cast("int").alias("tier"), F.col("b.n").cast("int").alias("max_flow"))
    out = own.join(best, "query_id").join(all_taken.withColumn("selected", F.lit(True)), ["query_id", "place", "tier"], "left")
    return out.select(*own.columns, "tier", F.coalesce("selected", F.lit(False)).alias("selected"), "max_flow")


def decide(rows: DataFrame, max_total: int = MAX_TOTAL, tiers=TIERS) -> DataFrame:
    """All candidates with tier, selected, max_flow, and their tier's limits."""
    own = candidates(rows)
    free = all(cat >= max_total or brand >= max_total for cat, brand in tiers)
    out = (_by_windows if free else _by_chains)(own, max_total, tiers)
    limit = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in tiers]), F.col("tier"))
    return out.withColumn("per_category", limit(0)).withColumn("per_brand", limit(1))


def selected(decided: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("rank")
    brand = F.when(F.col("brand") == "", "-").otherwise(F.col("brand"))
    return decided.where("selected").select("query_id", F.row_number().over(order).alias("slot"), "rank", "product_name", "category", brand.alias("brand"), F.coalesce(F.col("score").cast("string"), F.lit("-")).alias("score"), "tier")


def rejected(decided: DataFrame, limit: int = EXPLAINED, max_total: int = MAX_TOTAL) -> DataFrame:
    """The best-ranked candidates that were left out, and why."""
    for key in ("category", "brand"):
        decided = decided.withColumn(f"used_{key}", F.sum(F.col("selected").cast("int")).over(W.partitionBy("query_id", f"{key}_key")))
    label = F.when(F.col("brand") == "", "Unknown").otherwise(F.col("brand_label"))
    reason = (
        F.when((F.col("per_category") < max_total) & (F.col("used_category") >= F.col("per_category")), F.concat(F.lit("category limit reached ("), "category_label", F.lit(")")))
        .when((F.col("per_brand") < max_total) & (F.col("used_brand") >= F.col("per_brand")), F.concat(F.lit("brand limit reached ("), label, F.lit(")")))
        .otherwise(F.lit(f"all {max_total} recommendation slots already used"))
    )
    order = W.partitionBy("query_id").orderBy("rank")
    out = decided.where("not selected").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return out.select("query_id", "position", "rank", "product_name", reason.alias("reason"))


def constraints(decided: DataFrame, max_total: int = MAX_TOTAL) -> DataFrame:
    """query_id, kind, label, used, allowed, ok: the limits as the selected rows keep them."""
    chosen = decided.where("selected")
    total = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("used")).select("query_id", F.lit("total").alias("kind"), F.lit("Total recommendations").alias("label"), "used", F.lit(max_total).alias("allowed"))
    cats = chosen.groupBy("query_id", "category_key").agg(F.count(F.lit(1)).alias("used"), F.first("category_label").alias("label"), F.first("per_category").alias("allowed"))
    brands = chosen.where("brand <> ''").groupBy("query_id", "brand_key").agg(F.count(F.lit(1)).alias("used"), F.first("brand_label").alias("label"), F.first("per_brand").alias("allowed"))
    every = total.unionByName(cats.select("query_id", F.lit("category").alias("kind"), F.concat(F.lit("Category: "), "label").alias("label"), "used", "allowed"))
    every = every.unionByName(brands.select("query_id", F.lit("brand").alias("kind"), F.concat(F.lit("Brand: "), "label").alias("label"), "used", "allowed"))
    return every.withColumn("ok", F.col("used") <= F.col("allowed"))


def status(queries: DataFrame, rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Each query's outcome: how many were selected, the flow, and a note where nothing could be."""
    given = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("given"))
    done = decided.groupBy("query_id").agg(F.sum(F.col("selected").cast("int")).alias("selected"), F.first("max_flow").alias("max_flow"))
    out = queries.select("query_id").join(given, "query_id", "left").join(done, "query_id", "left")
    note = F.when(F.col("given").isNull(), "No products available for recommendation.").when(F.col("selected").isNull(), "No valid products available.").when(F.col("selected") != F.col("max_flow"), "Selected products differ from the flow.").otherwise("ok")
    return out.select("query_id", F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("max_flow", F.lit(0)).alias("max_flow"), note.alias("note"))
