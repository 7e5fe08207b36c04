"""Range-bounded reads of a topic.

Every function works on a topic DataFrame with the columns of Spark's Kafka source (key, value, topic,
partition, offset, timestamp, timestampType). ``read_range`` opens a real topic with the same rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.errors import EmptyRangeError, SpecError
from ferryline.session import broadcast_rows, collect_if_short

NOTHING_IN_RANGE = "no partition has offsets or timestamps that satisfy the range"


class RangeType(Enum):
    TIME = "TIME"
    OFFSET = "OFFSET"

    @classmethod
    def parse(cls, text: str) -> "RangeType":
        try:
            return cls(text.upper())
        except (ValueError, AttributeError):
            raise SpecError(f"range type {text!r} does not exist, use TIME or OFFSET") from None


@dataclass(frozen=True)
class RecordRange:
    """Both ends are inclusive; reversed ends are swapped."""

    start: int
    end: int
    kind: RangeType = RangeType.OFFSET

    def __post_init__(self) -> None:
        low, high = min(self.start, self.end), max(self.start, self.end)
        object.__setattr__(self, "start", low)
        object.__setattr__(self, "end", high)


# A topic is a DataFrame of its records, or a function that opens it for a range.
Topic = DataFrame | Callable[[RecordRange], DataFrame]


def timestamp_ms(column: str = "timestamp") -> Column:
    """Record time as epoch milliseconds."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def records(topic: DataFrame) -> DataFrame:
    """What travels on through a job: value and time, with the position kept for audit. Keys are not read."""
    ms = timestamp_ms()
    return topic.select("partition", "offset", "value", F.when(ms > 0, ms).alias("ts_ms"))


def resolve_offsets(topic: DataFrame, bounds: RecordRange) -> DataFrame:
    """Per partition, where an OFFSET range starts, and whether the partition takes part.

    A partition whose oldest offset lies past the end of the range is out; one whose oldest offset lies past
    the start begins at that oldest offset.
    """
    return (
        topic.groupBy("partition")
        .agg(F.min("offset").alias("beginning"))
        .select(
            "partition",
            "beginning",
            F.greatest("beginning", F.lit(bounds.start)).alias("start_offset"),
            F.lit(bounds.end + 1).cast("bigint").alias("stop_offset"),
            (F.col("beginning") <= bounds.end).alias("qualifies"),
        )
    )


def resolve_times(topic: DataFrame, bounds: RecordRange) -> DataFrame:
    """Per partition, the offsets a TIME range covers, and whether the partition takes part.

    Reading starts at the first offset whose time reaches the start of the range and stops before the first
    offset whose time passes its end, so late in-range records after the stop are not read and early records
    after the start are. A record past the end also reaches the start, so the stop is never before the start
    and both are plain minima: one aggregate with map-side combine, no ordering of the partition.
    """
    ms = timestamp_ms()
    reached = ms >= bounds.start
    first_ms = F.col("start_ms")
    same_second = F.floor(first_ms / 1000) == F.floor(F.lit(bounds.start) / 1000)
    return (
        topic.groupBy("partition")
        .agg(
            F.min("offset").alias("beginning"),
            F.min(F.when(reached, F.col("offset"))).alias("start_offset"),
            F.min_by(ms, F.when(reached, F.col("offset"))).alias("start_ms"),
            F.min(F.when(ms > bounds.end, F.col("offset"))).alias("stop_offset"),
        )
        .withColumn(
            "qualifies",
            F.col("start_offset").isNotNull() & (same_second | (first_ms <= bounds.end)),
        )
    )


def read_offsets(topic: DataFrame, bounds: RecordRange) -> DataFrame:
    """Rows of an OFFSET range. The rule per partition comes down to one filter, which reaches the scan."""
    return topic.filter(F.col("offset").between(bounds.start, bounds.end))


def read_times(topic: DataFrame, bounds: RecordRange, require: bool = False) -> DataFrame:
    """Rows of a TIME range: the resolved starts and stops joined to the topic, which is not shuffled.

    The resolved table has one row per topic partition. Once its length has been checked it is broadcast, and
    the outermost offsets also become a plain filter, which reaches the scan.
    """
    found = resolve_times(topic, bounds).filter("qualifies").select("partition", "start_offset", "stop_offset")
    rows = collect_if_short(found)
    if rows is not None:
        if require and not rows:
            raise EmptyRangeError(NOTHING_IN_RANGE)
        found = broadcast_rows(topic.sparkSession, rows, found.schema)
        outer = F.lit(True)
        if rows:
            outer = F.col("offset") >= min(r.start_offset for r in rows)
            if all(r.stop_offset is not None for r in rows):
                outer = outer & (F.col("offset") < max(r.stop_offset for r in rows))
        topic = topic.filter(outer)
    inside = (F.col("offset") >= F.col("start_offset")) & (
        F.col("stop_offset").isNull() | (F.col("offset") < F.col("stop_offset"))
    )
    return topic.join(found, "partition").filter(inside).select(*topic.columns)


def read(topic: Topic, bounds: RecordRange, require: bool = True) -> DataFrame:
    """The rows of ``bounds``; with ``require``, an error when no partition has any part in the range."""
    if not isinstance(topic, DataFrame):
        rows = topic(bounds)
        if require and rows.isEmpty():
            raise EmptyRangeError(NOTHING_IN_RANGE)
        return rows
    if bounds.kind is RangeType.TIME:
        return read_times(topic, bounds, require)
    # Some partition begins at or before the end of the range if some offset lies there.
    if require and topic.filter(F.col("offset") <= bounds.end).isEmpty():
        raise EmptyRangeError(NOTHING_IN_RANGE)
    return read_offsets(topic, bounds)


def offset_tracker(rows: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """First and last offset and time read per partition; -1 for a listed partition that gave no rows."""
    ms = timestamp_ms()
    seen = rows.groupBy("partition").agg(
        F.min("offset").alias("first_offset"),
        F.min_by(ms, "offset").alias("first_ts"),
        F.max("offset").alias("last_offset"),
        F.max_by(ms, "offset").alias("last_ts"),
    )
    if partitions is None:
        return seen
    listed = partitions.select("partition").distinct()
    return listed.join(seen, "partition", "left").na.fill(-1, ["first_offset", "first_ts", "last_offset", "last_ts"])


def stream_offsets(progress: Mapping[str, Any]) -> dict[str, dict[int, int]]:
    """Per topic and partition, the offset a streaming run has come to, from one of its progress reports."""
    reached: dict[str, dict[int, int]] = {}
    for source in progress["sources"]:
        ends = source["endOffset"]
        for name, offsets in (json.loads(ends) if isinstance(ends, str) else ends or {}).items():
            reached.setdefault(name, {}).update({int(p): o for p, o in offsets.items()})
    return reached


# --- real topics -------------------------------------------------------------------------------------------


def offset_options(
    topic: str, bounds: RecordRange, beginnings: Mapping[int, int], ends: Mapping[int, int]
) -> dict[str, str]:
    """Kafka reader options for an OFFSET range, from each partition's oldest and next offset.

    The reader wants every partition named, so one outside the range reads from its end to its end. Ends are
    exclusive there and never past the log, so a range that ends in the future stops at the current end.
    """
    starts: dict[str, int] = {}
    stops: dict[str, int] = {}
    out = True
    for part, oldest in sorted(beginnings.items()):
        end = ends[part]
        if oldest > bounds.end:
            starts[str(part)] = stops[str(part)] = end
            continue
        out = False
        starts[str(part)] = min(max(oldest, bounds.start), end)
        stops[str(part)] = max(min(bounds.end + 1, end), starts[str(part)])
    if out:
        raise EmptyRangeError(NOTHING_IN_RANGE)
    return {
        "subscribe": topic,
        "startingOffsets": json.dumps({topic: starts}),
        "endingOffsets": json.dumps({topic: stops}),
    }


def time_options(topic: str, bounds: RecordRange, partitions: Sequence[int] = ()) -> dict[str, str]:
    """Kafka reader options for a TIME range.

    For a time the broker gives the first offset that reaches it, which is exactly where a range starts and,
    asked one millisecond past the end, where it stops. Each record of the range is then read once and
    nothing else is. A partition without a record that late starts at its end, so it gives no rows.
    """
    options = {"subscribe": topic, "startingOffsetsByTimestampStrategy": "latest"}
    for side, ms in (("starting", bounds.start), ("ending", bounds.end + 1)):
        if partitions:
            options[f"{side}OffsetsByTimestamp"] = json.dumps({topic: {str(p): ms for p in partitions}})
        else:
            options[f"{side}Timestamp"] = str(ms)
    return options


def open_topic(spark: SparkSession, servers: str, options: Mapping[str, str]) -> DataFrame:
    """A real topic through Spark's Kafka source (needs the spark-sql-kafka package on the cluster)."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).options(**options).load()


def kafka_topic(
    spark: SparkSession,
    servers: str,
    topic: str,
    log_bounds: Callable[[], tuple[Mapping[int, int], Mapping[int, int]]] | None = None,
) -> Callable[[RecordRange], DataFrame]:
    """A real topic for jobs: it is opened per range, with both ends of the range pushed to the broker.

    An OFFSET range needs ``log_bounds``, which returns each partition's oldest and next offset (from an admin
    client, say), because Spark's reader takes offsets only per partition.
    """

    def open_range(bounds: RecordRange) -> DataFrame:
        if bounds.kind is RangeType.TIME:
            return open_topic(spark, servers, time_options(topic, bounds))
        if log_bounds is None:
            raise SpecError(f"an OFFSET range of topic {topic} needs the bounds of its log")
        return open_topic(spark, servers, offset_options(topic, bounds, *log_bounds()))

    return open_range


def stream_start(topic: str, bounds: RecordRange, beginnings: Mapping[int, int] | None = None, ends: Mapping[int, int] | None = None) -> dict[str, str]:
    """Kafka reader options that let a stream begin where a range does instead of at the oldest record.

    A TIME range begins at the first record that reaches its start, which the broker finds, also in partitions that have no
    such record yet. An OFFSET range needs each partition's oldest and next offset, as Spark takes offsets only per partition.
    """
    if bounds.kind is RangeType.TIME:
        return {"startingTimestamp": str(bounds.start), "startingOffsetsByTimestampStrategy": "latest"}
    if beginnings is None or ends is None:
        return {}
    starts = {str(part): min(max(oldest, bounds.start), ends[part]) for part, oldest in sorted(beginnings.items())}
    return {"startingOffsets": json.dumps({topic: starts})}


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    log_bounds: Callable[[], tuple[Mapping[int, int], Mapping[int, int]]] | None = None,
    **options: str,
) -> Callable[[RecordRange], DataFrame]:
    """A real topic for streaming jobs, opened where the job's range begins; the rules of the range are the job's."""

    def open_range(bounds: RecordRange) -> DataFrame:
        known = log_bounds() if log_bounds is not None and bounds.kind is RangeType.OFFSET else (None, None)
        stream = open_stream(spark, servers, topic, **{**stream_start(topic, bounds, *known), **options})
        return stream if bounds.kind is RangeType.TIME else read_offsets(stream, bounds)

    return open_range


def open_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The streaming form of ``open_topic``, for ``availableNow`` runs; ``maxOffsetsPerTrigger`` bounds a batch."""
    settings = {"subscribe": topic, "startingOffsets": "earliest", **options}
    if "startingTimestamp" in options:
        del settings["startingOffsets"]
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).options(**settings).load()
