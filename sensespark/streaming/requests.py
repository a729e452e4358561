"""Streams of requests against a fixed model.

Ranking within a request takes several stages, which a native streaming plan
can't hold, so each micro-batch runs as a batch plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer(requests: DataFrame, reply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write ``reply(batch)`` of each micro-batch below ``path``.

    A batch has a folder of its own that a repeated run overwrites, so that
    each request is answered once, also after a failure.
    """

    def run(batch: DataFrame, number: int) -> None:
        reply(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def nearest_reply(senses: DataFrame, pool: DataFrame, k: int = 10) -> Callable[[DataFrame], DataFrame]:
    """Reply to heads (hw) with their nearest senses."""
    from sensespark.operators import model

    def reply(batch: DataFrame) -> DataFrame:
        heads = batch.select(F.trim("hw").alias("word")).distinct()
        return model.nearest(senses.join(heads, "word"), pool, k)

    return reply
