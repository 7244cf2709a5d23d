"""python -m skein [FOLDER]: search a folder of product texts from the console."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from .engine import Engine
from .plans import render


def ask(lines: Iterable[str], question: str) -> bool:
    print(question, end="", flush=True)
    return (next(lines, "n") or "").strip().lower() in ("y", "yes")


def answer(engine: Engine, text: str, lines: Iterable[str]) -> None:
    asked = engine.queries(text)
    understood = engine.prepare(asked).collect()
    if not understood:
        print("Please enter a valid search query.")
        return
    for r in engine.changes(asked).orderBy("change_no").collect():
        print(f"{r.term} -> {r.corrected} (distance {r.distance})")
    found = engine.rank(asked).persist()
    if not found.limit(1).count():
        print(render.fuzzy_results(engine.fallback(asked, found)))
        return
    print(f"Algorithm: {understood[0].algorithm}")
    print(render.results(found))
    if ask(lines, "Recommendations? (Y/N) "):
        print(render.recommendations(engine.recommend(asked)))


def loop(engine: Engine, lines: Iterable[str]) -> None:
    """Commands: exit, /trie (products by prefix), /time (two plans of a pattern count); anything else is searched."""
    lines = iter(lines)
    for line in lines:
        text = line.strip()
        if text.lower() == "exit":
            return
        if not text:
            print("Please enter a search query.")
        elif text.lower() == "/trie":
            asked = engine.queries(next(lines, "").strip())
            print(render.prefix_results(engine.products_by_prefix(asked)))
        elif text.lower() == "/time":
            print(render.timing(engine.count_pattern(next(lines, "").strip())))
        else:
            answer(engine, text, lines)


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.appName("skein").config("spark.ui.enabled", "false").getOrCreate()
    try:
        loop(Engine.open(spark, argv[0] if argv else "corpus"), sys.stdin)
    except FileNotFoundError as e:
        print(f"{e}. Give the folder of product texts as the first argument.")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
