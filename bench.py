"""Headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores: one warm-up, then the median of three; one JSON line.

The catalogue of `part` is built once in a session, as an index is; `cold` has each query's first run, of which the
first one that ranks builds it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "norm_tokens doc_freq_vocab pattern_total_by_lang pattern_count_overlap spell_documents rank_top10 fuzzy_search prefix_products_and "
    "parse_fields corpus_search recommend_selected maxflow_small"
).split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    conf = {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from skein.plans import registry

    own, seconds, cold = registry.queries(), {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            own[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        cold[name] = round(runs[0], 3)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
