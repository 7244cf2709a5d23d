"""Queries as a stream: each micro-batch is searched against the standing catalogue.

Batches carry no state between them, so there is no watermark; the sink writes each batch once under its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

SCHEMA = "query_id int, query_text string"


def query_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of JSON lines {query_id, query_text}, as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def answer_stream(engine: Engine, queries: DataFrame, out: str, checkpoint: str, limit: int = 10) -> StreamingQuery:
    """Write each batch's results to out/batch=N; a batch that is tried again overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        engine.rank(batch, limit).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
