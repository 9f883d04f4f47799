"""Questions that arrive as a stream, answered batch by batch and appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def serve(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append ``retrieve(batch)`` for each micro-batch of a streaming ``questions`` frame to a parquet folder.

    Each batch goes to its own partition ``batch``, which a repeated batch overwrites, so a
    restart neither loses nor doubles rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        retrieve(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
