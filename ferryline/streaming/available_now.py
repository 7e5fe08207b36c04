"""The streaming form of a job: everything that is there now, then stop.

Spark's checkpoint remembers how far a run came, so a rerun goes on instead of starting over, and each
micro-batch is committed as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ferryline.sinks.files import write_as_they_come


def drain_to_parquet(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df
) -> StreamingQuery:
    """Run ``transform`` over a stream and append its rows to Parquet, until the input present is used up."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain_to_batches(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand each micro-batch to ``write`` as a plain DataFrame, until the input present is used up."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain_to_json_arrays(
    stream: DataFrame,
    path: str,
    job: str,
    checkpoint: str,
    value: str = "value",
    max_bytes: int | str | None = None,
    max_count: int | None = None,
) -> StreamingQuery:
    """Segmented JSON array files from a stream, in one folder per micro-batch.

    Spark runs a batch again if a failure hits between its files and its checkpoint, so a batch replaces
    whatever files it finds in its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        content = batch.select(F.col(value).alias("value"))
        write_as_they_come(content, f"{path}/{number}", job, "json", max_bytes, max_count, replace=True)

    return drain_to_batches(stream, checkpoint, write)
