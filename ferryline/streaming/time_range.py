"""A TIME range of a streaming topic.

Reading a partition begins at its first record that reaches the start of the range and ends for good before the
first one that lies past the end. Both are minima of offsets, so a micro-batch is not ordered and its records are not
shuffled: one aggregate with a row for each topic partition finds where reading begins and ends in it, and a broadcast join
of that row filters the records. What is known of a partition (begun, ended) is kept beside the checkpoint, batch by
batch, so a batch that is run again and a run that goes on later see what the batches before them left.

A partition's records have to arrive in the order of their offsets from batch to batch, as those of Kafka do; within a
batch any order will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ferryline.session import checked_broadcast
from ferryline.sources.topic import RecordRange, timestamp_ms
from ferryline.streaming.available_now import drain_to_batches
from ferryline.streaming.ledger import Ledger

STATE_SCHEMA = "partition int, begun boolean, ended boolean"


class TimeGate:
    """Lets the records of a TIME range through, micro-batch by micro-batch."""

    def __init__(self, spark: SparkSession, bounds: RecordRange, checkpoint: str) -> None:
        self.bounds = bounds
        self.states = Ledger(spark, checkpoint, "time-range", STATE_SCHEMA)

    def admit(self, batch: DataFrame, number: int) -> DataFrame:
        """The records of a batch that lie in the range; notes how far each partition has come."""
        ms, offset = timestamp_ms(), F.col("offset")
        found = batch.groupBy(F.col("partition").cast("int").alias("partition")).agg(
            F.min(F.when(ms >= self.bounds.start, offset)).alias("first"), F.min(F.when(ms > self.bounds.end, offset)).alias("late")
        )
        before = self.states.read(number - 1)
        met = found.join(checked_broadcast(before), "partition", "full").fillna(False, ["begun", "ended"])
        state = met.select(
            "partition",
            (F.col("begun") | F.col("first").isNotNull()).alias("begun"),
            (F.col("ended") | F.col("late").isNotNull()).alias("ended"),
            F.when(F.col("begun"), F.lit(0).cast("long")).otherwise(F.col("first")).alias("from_offset"),
            F.col("late").alias("to_offset"),
            F.col("ended").alias("was_ended"),
        ).persist(StorageLevel.MEMORY_AND_DISK)
        self.states.write(number, state.select("partition", "begun", "ended"))
        self.states.drop(number - 3)
        reading = checked_broadcast(state.filter("not was_ended and from_offset is not null").select("partition", "from_offset", "to_offset"))
        state.unpersist()
        inside = (offset >= F.col("from_offset")) & (F.col("to_offset").isNull() | (offset < F.col("to_offset")))
        return batch.join(reading, "partition").filter(inside).select(*batch.columns)


def drain_time_range(
    stream: DataFrame, bounds: RecordRange, checkpoint: str, write: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Hand the records of a TIME range of a streaming topic to ``write``, until the input present is used up."""
    gate = TimeGate(stream.sparkSession, bounds, checkpoint)

    def write_batch(batch: DataFrame, number: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write(gate.admit(kept, number), number)
        finally:
            kept.unpersist()

    return drain_to_batches(stream, checkpoint, write_batch)
