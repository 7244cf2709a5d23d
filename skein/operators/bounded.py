"""The best products of a query without scoring every match: postings in blocks, and the most that a block can give.

Products are put in order of category and name and cut into blocks, so like ones lie together. For each token, a block
has its postings as one row; a small summary says which tokens of which fields a block has. From that alone follows
the most points that a query can earn in a block: its terms' fields, bonuses that need all terms, the asked category. A
query opens its most promising blocks first and scores them exactly; their k-th best score is the bar. Only blocks that
may reach the bar are opened then. No other block can hold one of the best k, so the result is that of scoring everything.

Defined cases are those of operators.search; a query with fewer than k matches opens all its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import index
from ..sources.staging import materialize
from . import search
from .catalog import postings
from .spelling import Hint, batch_hint, shuffled

BLOCK_PRODUCTS, PART_PRODUCTS = 256, 1_000_000
#: Blocks that a query opens before it has a bar.
FIRST_BLOCKS = 2
FIELDS = ("name", "brand", "category", "description")


@dataclass(frozen=True)
class Blocks:
    catalog: DataFrame  # with block
    postings: DataFrame  # field, token, block, products
    summary: DataFrame  # field, token, block, n
    categories: DataFrame  # block, category (lower case)


def tables(catalog: DataFrame, block_products: int = BLOCK_PRODUCTS) -> list[index.Kept]:
    """What to keep of a catalogue."""
    order = ["rec_category", "name_norm", "corpus_pos"]
    parts = max(1, -(-catalog.count() // PART_PRODUCTS))
    placed = catalog.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()  # a part's number above 33 bits that count its rows, which are in order
    placed = materialize(placed.select("corpus_pos", F.shiftleft(F.shiftright(row, 33), 33).bitwiseOR(F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(block_products))).alias("block")), "blocks")
    whole = catalog.join(shuffled(placed), "corpus_pos")
    rows = postings(catalog).join(shuffled(placed), "corpus_pos").groupBy("field", "token", "block").agg(F.sort_array(F.collect_list("corpus_pos")).alias("products"))
    rows = materialize(rows, "blocked-postings")
    return [
        index.Kept("catalog", whole.select("block", *search.SCORED, "brand"), ("corpus_pos",)),
        index.Kept("postings", rows, ("field", "token"), ("field", "token", "block")),
        index.Kept("summary", rows.select("field", "token", "block", F.size("products").cast("long").alias("n")), ("field", "token"), ("field", "token", "block")),
        index.Kept("categories", whole.select("block", F.lower("rec_category").alias("category")).distinct(), ("category",), ("category", "block")),
    ]


def opened(kept: dict[str, DataFrame]) -> Blocks:
    return Blocks(kept["catalog"], kept["postings"], kept["summary"], kept["categories"])


def bounds(blocks: Blocks, prepared: DataFrame, synonyms: DataFrame, hint: Hint) -> DataFrame:
    """query_id, block, most (points that a product there may have), n (postings there that match a term)."""
    terms = prepared.select("query_id", F.explode("terms").alias("term"))
    hits = blocks.summary.join(search.asked_tokens(terms, blocks.summary.select("field", "token").distinct(), synonyms, hint), ["field", "token"])
    flags = [F.max((F.col("field") == f).cast("int")).alias(f) for f in FIELDS]
    exact = F.max(((F.col("field") == "name") & (F.col("token") == F.col("term"))).cast("int")).alias("exact")
    per = hits.groupBy("query_id", "term", "block").agg(*flags, exact, F.sum("n").alias("n"))
    strong = F.greatest("name", "brand", "category")
    per = per.groupBy("query_id", "block").agg(
        F.sum(search.term_points(*[F.col(f) for f in FIELDS])).alias("points"), F.sum(strong).alias("strong"), F.sum(F.greatest(strong, "description")).alias("matched"), F.sum("exact").alias("exact"), F.sum("n").alias("n")
    )
    # Blocks of the asked category may hold products that match no term.
    asked = hint(prepared.where("intent <> ''").select("query_id", F.lower("intent").alias("category")))
    right = blocks.categories.join(asked, "category").select("query_id", "block", F.lit(1).alias("right"))
    per = per.join(right, ["query_id", "block"], "full").na.fill(0).join(hint(prepared.select("query_id", "terms", "intent")), "query_id")
    n = F.size("terms")
    # A name that holds the phrase has each of its words as a token.
    name = F.when(F.col("exact") == n, search.EXACT_NAME).otherwise(0)
    category = F.when(F.col("intent") == "", 0).when(F.col("right") == 1, search.RIGHT_CATEGORY).otherwise(search.WRONG_CATEGORY)
    most = F.col("points") + name + search.all_terms(n, F.col("strong"), F.col("matched")) + category + search.PHRASE
    return per.select("query_id", "block", most.cast("long").alias("most"), "n").where("most > 0")


def _score(blocks: Blocks, chosen: DataFrame, prepared: DataFrame, synonyms: DataFrame, hint: Hint) -> DataFrame:
    """Exact scores of the products in the chosen blocks: query_id, block."""
    terms = prepared.select("query_id", F.explode("terms").alias("term"))
    chosen = batch_hint(chosen)(chosen)  # as many as there are blocks
    tokens = search.asked_tokens(terms, blocks.summary.select("field", "token").distinct(), synonyms, hint)
    hits = blocks.postings.join(tokens, ["field", "token"]).join(chosen, ["query_id", "block"])
    flags = [F.max((F.col("field") == f).cast("int")).alias(f) for f in FIELDS]
    found = hits.select("query_id", "term", "field", F.explode("products").alias("corpus_pos")).groupBy("query_id", "term", "corpus_pos").agg(*flags)
    asked = prepared.where("intent <> ''").select("query_id", F.lower("intent").alias("k")).join(chosen, "query_id")
    asked = batch_hint(asked)(asked)
    wanted = blocks.catalog.select("corpus_pos", "block", F.lower("rec_category").alias("k")).join(asked, ["k", "block"]).select("query_id", "corpus_pos")
    return search.scored(blocks.catalog, found, wanted, prepared, hint)


@dataclass(frozen=True)
class Answer:
    best: DataFrame  # query_id, rank, corpus_pos, score
    work: DataFrame  # query_id, postings, opened: how many postings match, and how many were in opened blocks


def rank(blocks: Blocks, prepared: DataFrame, synonyms: DataFrame, limit: int = search.SHOWN, hint: Hint | None = None) -> Answer:
    """The best `limit` of each prepared query."""
    hint = hint or batch_hint(prepared)
    # A query's blocks, most promising first: a row for each block that has one of its terms or its category.
    most = materialize(bounds(blocks, prepared, synonyms, hint), "bounds")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), "block"))
    now = materialize(most.withColumn("turn", turn).where(F.col("turn") <= FIRST_BLOCKS).select("query_id", "block"), "first-blocks")
    early = materialize(_score(blocks, now, prepared, synonyms, hint), "early")
    bar = early.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == limit).select("query_id", F.col("score").alias("bar"))
    rest = most.join(hint(bar), "query_id", "left").where(F.col("most") >= F.coalesce("bar", F.lit(0))).join(now, ["query_id", "block"], "left_anti")
    rest = materialize(rest.select("query_id", "block"), "later-blocks")
    late = _score(blocks, rest, prepared, synonyms, hint)
    both = now.union(rest).withColumn("__open", F.lit(True))
    work = most.join(both, ["query_id", "block"], "left").groupBy("query_id").agg(F.sum("n").alias("postings"), F.coalesce(F.sum(F.when(F.col("__open"), F.col("n"))), F.lit(0)).alias("opened"))
    return Answer(search.best(early.unionByName(late), limit).select("query_id", "rank", "corpus_pos", "score"), work)
