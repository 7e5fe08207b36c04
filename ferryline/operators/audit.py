"""Run history: append-only event tables, the current state of a run, and reports over many instances."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(columns: str) -> T.StructType:
    types = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "boolean": T.BooleanType}
    types["timestamp"] = T.TimestampType
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, types[kind]()) for name, kind in pairs])


JOB_EVENTS = _schema(
    "job_id string, event_time timestamp, parallelism int, error string, queue_size int, queued boolean,"
    " source_type string, sink_type string, source_data_type string, sink_data_type string,"
    " special_converter_name string, special_converter_subtype string, special_converter_args string,"
    " queue_time timestamp, creation_time timestamp, start_time timestamp, running_time timestamp,"
    " finish_time timestamp"
)
WORKER_EVENTS = _schema(
    "job_id string, event_time timestamp, worker_type string, worker_state string, thread_num int, error string"
)
COUNTERS = _schema("job_id string, event_time timestamp, side string, name string, counter_val bigint")

# Worker states and counter names.
STARTED, FINISHED, ERROR = "STARTED", "FINISHED", "ERROR"
READ_RECORDS, READ_OBJECTS, READ_FILES = "_read_records", "_read_objects", "_read_files"
EMPTY_POLLS, LAST_POLL_SIZE = "_empty_polls", "last_poll_size"
SKIPPED_RECORDS = "_skipped_records"

# The numbers an instance reports about its capacity.
CAPACITY_COLUMNS = (
    "executing",
    "execution_capacity",
    "available_execution_slots",
    "waiting",
    "waiting_queue_size",
    "available_queue_slots",
)


class AuditLog:
    """The three tables of one deployment, as folders of Parquet files that are only ever appended to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, schema: T.StructType, rows: Sequence[dict[str, Any]]) -> None:
        now = datetime.now(timezone.utc)
        values = [[r.get(f, now if f == "event_time" else None) for f in schema.names] for r in rows]
        frame = self.spark.createDataFrame(values, schema).coalesce(1)
        frame.write.mode("append").parquet(f"{self.root}/{table}")

    def job(self, job_id: str, **changes: Any) -> None:
        """Record a run's creation, or any later change of it; only the changed fields are given."""
        self._append("job", JOB_EVENTS, [{"job_id": job_id, **changes}])

    def error(self, job_id: str, error: str) -> None:
        self.job(job_id, error=error)

    def workers(self, job_id: str, events: Sequence[dict[str, Any]]) -> None:
        self._append("worker_event", WORKER_EVENTS, [{"job_id": job_id, **e} for e in events])

    def counters(self, job_id: str, side: str, values: dict[str, int]) -> None:
        rows = [{"job_id": job_id, "side": side, "name": k, "counter_val": v} for k, v in values.items()]
        if rows:
            self._append("counters", COUNTERS, rows)

    def table(self, name: str) -> DataFrame:
        schema = {"job": JOB_EVENTS, "worker_event": WORKER_EVENTS, "counters": COUNTERS}[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def current(self) -> DataFrame:
        return current_state(self.table("job"), ["job_id"], "event_time")


def latest(value: Column, order: Column) -> Column:
    """The value that was set last; events that left it unset do not count."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def current_state(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key with every field's last set value.

    A plain aggregate with map-side combine, so a key with very many events still moves as one row per task.
    """
    fields = [c for c in events.columns if c not in (*keys, order)]
    return events.groupBy(*keys).agg(
        *[latest(F.col(c), F.col(order)).alias(c) for c in fields], F.max(order).alias(order)
    )


def counters_by_worker(rows: DataFrame, worker: Column | None = None) -> DataFrame:
    """Records read per worker; a worker is a Spark task unless a column says otherwise."""
    worker = F.spark_partition_id() if worker is None else worker
    return (
        rows.groupBy(worker.alias("worker"))
        .agg(F.count("*").alias("counter_val"))
        .withColumn("name", F.concat(F.col("worker").cast("string"), F.lit(READ_RECORDS)))
    )


def partition_counters(rows: DataFrame) -> DataFrame:
    """Records read per topic partition."""
    counted = rows.groupBy("partition").agg(F.count("*").alias("counter_val"))
    return counted.select(
        F.concat(F.lit(f"{READ_RECORDS}_"), F.col("partition").cast("string")).alias("name"), "counter_val"
    )


def poll_counters(polls: Sequence[int]) -> dict[str, int]:
    """Counters of a streaming run from the records of each micro-batch; a micro-batch is a poll."""
    return poll_totals(sum(polls), sum(n == 0 for n in polls), polls[-1] if polls else 0)


def poll_totals(n_read: int, n_empty: int, last: int) -> dict[str, int]:
    return {READ_RECORDS: n_read, EMPTY_POLLS: n_empty, LAST_POLL_SIZE: last}


def merge_counters(counters: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """One value per counter name: source counters first, sink counters over them."""
    rank = F.when(F.col("side") == "sink", 1).otherwise(0)
    return counters.groupBy(*keys, "name").agg(F.max_by("counter_val", rank).alias("counter_val"))


def lookup(jobs: DataFrame, workers: DataFrame, counters: DataFrame, job_id: str) -> DataFrame:
    """One run with its set of worker events and its set of counters, as one row per member.

    The sets are rows rather than collected arrays, so their size is not bounded by one task. A run without
    events and counters gives one row with a null ``kind``.
    """
    run = current_state(jobs.filter(F.col("job_id") == job_id), ["job_id"], "event_time").drop("event_time")
    events = workers.filter(F.col("job_id") == job_id).select(
        "job_id",
        F.lit("worker_event").alias("kind"),
        F.concat_ws("-", "worker_type", "thread_num").alias("name"),
        F.col("worker_state").alias("state"),
        F.lit(None).cast("bigint").alias("counter_val"),
    )
    values = counters.filter(F.col("job_id") == job_id).select(
        "job_id", F.lit("counter").alias("kind"), "name", F.lit(None).cast("string").alias("state"), "counter_val"
    )
    members = events.unionByName(values).distinct()
    return run.join(members, "job_id", "left")


def capacity(slots: DataFrame, columns: Sequence[str] = CAPACITY_COLUMNS) -> DataFrame:
    """Column-wise sum over instances."""
    return slots.agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])


def running_jobs(instances: DataFrame, jobs: str = "jobs") -> DataFrame:
    """All instances' jobs as one list."""
    return instances.select("instance", F.explode(jobs).alias("job_id"))


def merge_latest(entries: DataFrame, key: str, value: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Maps of several instances merged: per key, the entry of the last instance wins."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = F.max_by(F.struct(*value), rank).alias("_v")
    return entries.groupBy(key).agg(picked).select(key, "_v.*")


def holder_of(instances: DataFrame, job_id: str, jobs: str = "jobs") -> DataFrame:
    """The instances that hold a job."""
    return instances.filter(F.array_contains(jobs, job_id)).select("instance")
