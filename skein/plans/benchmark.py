"""Comparing two plans of one count: agreement, and timing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_by_position, count_overlapping

WARM_UP, ROUNDS, CLEAR = 3, 10, 0.05


def agree(texts: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """pattern_no, by_search, by_position: both totals of each pattern, in one pass."""
    own = F.col(column)
    sums = texts.agg(*[F.sum(f(own, p)).cast("long").alias(f"{n}{i}") for i, p in enumerate(patterns) for n, f in (("a", count_overlapping), ("b", count_by_position))])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("pattern_no"), F.col(f"a{i}").alias("by_search"), F.col(f"b{i}").alias("by_position")) for i in range(len(patterns))])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("agree", F.col("by_search") == F.col("by_position"))


def compare(texts: DataFrame, column: str, pattern: str, warm_up: int = WARM_UP, rounds: int = ROUNDS) -> dict:
    """Mean milliseconds of either plan over alternating rounds; a winner only if it is clearly faster.

    Raises if the two ever disagree.
    """
    plans = {"search": count_overlapping, "position": count_by_position}
    spent = dict.fromkeys(plans, 0.0)
    counts: set = set()
    for r in range(warm_up + rounds):
        for name in list(plans)[:: 1 if r % 2 == 0 else -1]:
            began = time.perf_counter()
            counts.add(texts.agg(F.sum(plans[name](F.col(column), pattern))).first()[0] or 0)
            if r >= warm_up:
                spent[name] += (time.perf_counter() - began) * 1000 / rounds
        if len(counts) > 1:
            raise AssertionError(f"the plans disagree: {sorted(counts)}")
    fast, slow = sorted(spent, key=spent.get)
    clear = spent[slow] - spent[fast] >= CLEAR * spent[slow]
    return {"count": counts.pop(), "ms": spent, "winner": fast if clear else None}
