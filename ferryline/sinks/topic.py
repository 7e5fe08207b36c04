"""The topic sink: batches of consecutive values spread over a topic's partitions in turn."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.operators.ordinal import with_ordinal

# monotonically_increasing_id() keeps the row position within its task in these bits.
_POSITION_MASK = (1 << 33) - 1


def round_robin(position: Column, batch_size: int, partitions: Sequence[int]) -> Column:
    """Batch ``k`` of a worker goes wholly to ``partitions[k mod P]``; every worker starts at the first."""
    if batch_size < 1:
        raise SpecError("batch size must be positive")
    if not partitions:
        raise SpecError("the topic has no partitions")
    turn = F.pmod(F.call_function("div", position, F.lit(batch_size)), F.lit(len(partitions))).cast("int")
    return F.get(F.array(*[F.lit(int(p)) for p in partitions]), turn)


def assign_partitions(rows: DataFrame, batch_size: int, partitions: Sequence[int]) -> DataFrame:
    """Workers are Spark's tasks and order is arrival order: no shuffle."""
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK))
    return rows.withColumn("partition", round_robin(position, batch_size, partitions))


def assign_partitions_ordered(
    rows: DataFrame, batch_size: int, partitions: Sequence[int], worker: str, order: Sequence[str]
) -> DataFrame:
    """Workers and their order are columns, so the outcome does not depend on how Spark splits the input."""
    ranked = with_ordinal(rows, order, [worker], "_position")
    return ranked.withColumn("partition", round_robin(F.col("_position"), batch_size, partitions)).drop("_position")


def to_records(rows: DataFrame, topic: str, value: str = "value", ts_ms: str | None = "ts_ms") -> DataFrame:
    """Rows for Spark's Kafka writer. The key is always null.

    That writer has no timestamp column, so a positive source time travels in the header ``ts_ms``.
    """
    columns = [
        F.lit(None).cast("binary").alias("key"),
        F.col(value).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.col("partition").cast("int").alias("partition"),
    ]
    if ts_ms is not None:
        header = F.struct(
            F.lit("ts_ms").alias("key"), F.encode(F.col(ts_ms).cast("string"), "UTF-8").alias("value")
        )
        columns.append(F.when(F.col(ts_ms) > 0, F.array(header)).alias("headers"))
    return rows.select(*columns)


def producer_options(batch_size: int, linger_ms: int = 1000) -> dict[str, str]:
    if batch_size < 1:
        raise SpecError("batch size must be positive")
    return {"kafka.batch.size": str(batch_size), "kafka.linger.ms": str(linger_ms)}


def write_topic(records: DataFrame, servers: str, options: Mapping[str, str]) -> None:
    """Through Spark's Kafka writer (needs the spark-sql-kafka package on the cluster); at least once."""
    writer = records.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.option("includeHeaders", "headers" in records.columns).options(**options).save()


def kafka_sink(servers: str, batch_size: int, **options: str) -> Callable[[DataFrame], None]:
    """A topic sink for a job: records to a real topic with the producer tuned to the batch size."""
    settings = {**producer_options(batch_size), **options}
    return lambda records: write_topic(records, servers, settings)
