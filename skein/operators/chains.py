"""The best choice under two limits at once, for many queries together: matroid intersection by augmenting chains.

A choice may hold so many candidates of a category and so many of a brand. Of the choices of the greatest size (at most
`max_total`) the one is wanted that does without the worst candidate if any does, then without the next worst, and so on.
That is a least cost, if a candidate costs more than all better ones together. From the best choice of a size, the best one
of the next size is a chain away: a candidate of a category with room comes in; where its brand is full, one of that
brand goes, which gives its category room for another, until a brand with room is met. The cheapest chain is found by
relaxing labels of categories and brands in turn, as windows, for all queries at once; labels carry their chain.

Costs are rows of longs, compared from the left, 48 places to a long: exact for any number of candidates.

What can't be chosen is left out first, exactly: of a category and brand more than the limits; of a key all beyond
2 * max_total better ones (some of these could come in instead); then places beyond a number that follows likewise. So a
query keeps at most 163 rows of any number of candidates (six in all), and one shuffle by query serves all windows.
A round adds one candidate to every query that isn't done and is written; there are at most max_total rounds.

Defined cases: limits or totals of 0 choose nothing; keys that are null are one key; candidates with equal ranks must have
different places; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import materialize

PLACES_A_LONG = 48


def possible(rows: DataFrame, max_total: int, per_category: int, per_brand: int) -> DataFrame:
    """query_id, place, category_key, brand_key -> what a best choice may hold, with `p`, the place among these from 0."""
    a, b = min(per_category, max_total), min(per_brand, max_total)
    if min(a, b) <= 0:
        return rows.limit(0).withColumn("p", F.lit(0))
    number = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy("place"))
    own = rows.select("query_id", "place", "category_key", "brand_key")
    own = own.withColumn("p", number("category_key", "brand_key")).where(F.col("p") <= min(a, b))
    # Both numbers are of the same rows: each cut alone keeps every best choice, and so do both.
    own = own.withColumn("p", F.greatest(number("category_key"), number("brand_key"))).where(F.col("p") <= 2 * max_total + 1)
    full = (max_total // a + max_total // b) * (2 * max_total + 1)
    return own.withColumn("p", number() - 1).where(F.col("p") <= max_total + full)


def _label(before: Column, costs: list[Column], sign: int) -> Column:
    """A chain, longer by this row: least cost first, then the fewest steps."""
    cost = [(before[f"cost{i}"] + sign * c).alias(f"cost{i}") for i, c in enumerate(costs)]
    return F.struct(*cost, (before["steps"] + 1).alias("steps"), F.concat(before["chain"], F.array("p")).alias("chain"))


def _augment(own: DataFrame, costs: list[Column], most: int, per_category: int, per_brand: int) -> DataFrame:
    """One candidate more for every query that has a chain; `more` tells which. No choice has over `most` candidates."""
    by_category, by_brand, by_query = W.partitionBy("query_id", "category_key"), W.partitionBy("query_id", "brand_key"), W.partitionBy("query_id")
    held = F.sum(F.col("chosen").cast("int"))
    zeros = [F.lit(0).cast("long").alias(f"cost{i}") for i in range(len(costs))]
    none = F.struct(*zeros, F.lit(0).alias("steps"), F.array().cast("array<int>").alias("chain"))
    own = own.withColumn("room", held.over(by_brand) < per_brand).withColumn("at_category", F.when(held.over(by_category) < per_category, none))
    for step in range(most + 1):
        comes = F.when(~F.col("chosen") & F.col("at_category").isNotNull(), _label(F.col("at_category"), costs, 1))
        own = own.withColumn("at_brand", F.min(comes).over(by_brand))
        if step < most:
            goes = F.when(F.col("chosen") & F.col("at_brand").isNotNull(), _label(F.col("at_brand"), costs, -1))
            own = own.withColumn("found", F.min(goes).over(by_category)).withColumn("at_category", F.least("at_category", "found"))
    best = F.min(F.when(F.col("room"), F.col("at_brand"))).over(by_query)
    own = own.withColumn("chain", best["chain"]).withColumn("more", F.col("chain").isNotNull())
    chosen = F.col("chosen") != F.coalesce(F.array_contains("chain", F.col("p")), F.lit(False))
    return own.select("query_id", "place", "category_key", "brand_key", "p", chosen.alias("chosen"), "more")


def choose(rows: DataFrame, max_total: int, per_category: int, per_brand: int) -> DataFrame:
    """rows: query_id, place (from the best), category_key, brand_key -> query_id, place of what is chosen."""
    own = possible(rows, max_total, per_category, per_brand)
    # As long as everything fits, the best candidates are the best choice of their number.
    so_far = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy("p"))
    own = own.withColumn("over", ((so_far("category_key") > per_category) | (so_far("brand_key") > per_brand) | (F.col("p") >= max_total)).cast("int"))
    begun = F.max("over").over(W.partitionBy("query_id").orderBy("p")) == 0
    own = own.select("query_id", "place", "category_key", "brand_key", "p", begun.alias("chosen"), F.lit(True).alias("more"))
    by_query = W.partitionBy("query_id")
    done = []
    while True:
        own = materialize(own.withColumn("size", F.sum(F.col("chosen").cast("int")).over(by_query)), "choice")
        done.append(own.where(F.col("chosen") & (~F.col("more") | (F.col("size") >= max_total))).select("query_id", "place"))
        left = own.where(F.col("more") & (F.col("size") < max_total))
        most, places = left.agg(F.max("size"), F.max("p")).first()
        if most is None:
            break
        longs = places // PLACES_A_LONG + 1
        # The worst place is in the first long, in its highest bit.
        parts = [F.when(F.floor(F.col("p") / PLACES_A_LONG) == longs - 1 - i, F.expr(f"shiftleft(1L, p % {PLACES_A_LONG})")).otherwise(F.lit(0).cast("long")) for i in range(longs)]
        own = _augment(left, parts, most, per_category, per_brand)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out
