"""Job descriptions: one source, at most one converter, one sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.functions import codecs
from ferryline.operators import audit, protobuf
from ferryline.operators.convert import Conversion, Converter, ConverterRegistry, convert
from ferryline.operators.ordinal import limit_workers
from ferryline.operators.segment import json_element_cost
from ferryline.sinks import files as file_sink
from ferryline.sinks import topic as topic_sink
from ferryline.sources import files as file_source
from ferryline.sources import topic as topic_source
from ferryline.streaming import available_now
from ferryline.streaming.ledger import Ledger
from ferryline.streaming.time_range import drain_time_range
from ferryline.types import DataType, Platform, check_side

SECTIONS = {
    ("source", Platform.KAFKA): "kafkaSource",
    ("source", Platform.S3): "s3Source",
    ("source", Platform.HDFS): "hdfsSource",
    ("sink", Platform.KAFKA): "kafkaSink",
    ("sink", Platform.S3): "s3Sink",
    ("sink", Platform.HDFS): "hdfsSink",
    ("sink", Platform.LOCAL_FS): "localSink",
}


@dataclass
class Side:
    platform: Platform
    data_type: DataType
    message: str | None
    options: dict[str, Any]


@dataclass
class Job:
    source: Side
    sink: Side
    parallelism: int
    conversion: Conversion
    converter: Converter | None
    job_id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass
class Environment:
    """Where names in a job description lead.

    Topics are DataFrames with the columns of Spark's Kafka source, or functions that open them for a range
    (``kafka_topic``); buckets are path prefixes. A topic sink is a function that takes the records
    (``kafka_sink``).
    """

    topics: Mapping[str, topic_source.Topic] = field(default_factory=dict)
    topic_sinks: Mapping[str, Callable[[DataFrame], None]] = field(default_factory=dict)
    topic_partitions: Mapping[str, Sequence[int]] = field(default_factory=dict)
    buckets: Mapping[str, str] = field(default_factory=dict)
    local_allowed: bool = False
    # Spark sizes its tasks by the input; with this a description's parallelism is an upper bound on them.
    limit_workers: bool = False
    converters: ConverterRegistry = field(default_factory=ConverterRegistry)


def _side(spec: Mapping[str, Any], name: str) -> Side:
    general = spec.get(f"{name}General")
    if not general:
        raise SpecError(f"{name}General is missing")
    platform = Platform.parse(general.get("platform"))
    declared = general.get("dataType") or {}
    data_type = DataType.parse(declared.get("type"))
    check_side(platform, data_type, name)
    section = SECTIONS[name, platform]
    if not spec.get(section):
        raise SpecError(f"{platform.name} {name} configuration ({section}) has not been supplied")
    return Side(platform, data_type, declared.get("specificType"), dict(spec[section]))


def resolve(spec: Mapping[str, Any], env: Environment, **conversion: Any) -> Job:
    """Check a description and settle every choice; nothing is read yet."""
    source, sink = _side(spec, "source"), _side(spec, "sink")
    parallelism = spec.get("parallelism", 1)
    if parallelism < 1:
        raise SpecError("parallelism must be at least 1")
    named = spec.get("specialConverter") or {}
    chosen = Conversion(
        source.data_type,
        sink.data_type,
        source.message,
        sink.message,
        named.get("name"),
        named.get("specificType"),
        tuple(named.get("args") or ()),
        **conversion,
    )
    for side in (source, sink):
        if side.data_type is DataType.PROTOBUF:
            chosen.protos.get(side.message)
    converter = env.converters.choose(chosen)
    _check_places(source, sink, env)
    return Job(source, sink, parallelism, chosen, converter)


def _check_places(source: Side, sink: Side, env: Environment) -> None:
    if source.platform is Platform.KAFKA:
        if source.options.get("topic") not in env.topics:
            raise SpecError(f"topic {source.options.get('topic')!r} does not exist")
        topic_source.RangeType.parse(source.options.get("rangeType"))
    if sink.platform is Platform.KAFKA:
        if sink.options.get("topic") not in env.topic_sinks:
            raise SpecError(f"topic {sink.options.get('topic')!r} does not exist")
        if not env.topic_partitions.get(sink.options["topic"]):
            raise SpecError(f"the partitions of topic {sink.options['topic']!r} are not known")
        if int(sink.options.get("batchSize") or 0) < 1:
            raise SpecError("batch size must be positive")
    for side in (source, sink):
        if side.platform is Platform.S3 and side.options.get("bucket") not in env.buckets:
            raise SpecError(f"bucket {side.options.get('bucket')!r} does not exist")
    if sink.platform is Platform.LOCAL_FS and not env.local_allowed:
        raise SpecError("this instance may not write to a local folder")


def _bounds(job: Job) -> topic_source.RecordRange:
    options = job.source.options
    return topic_source.RecordRange(int(options["from"]), int(options["to"]), topic_source.RangeType.parse(options["rangeType"]))


def _messages(records: DataFrame, job: Job) -> DataFrame:
    """Records of a topic as rows (ts_ms, value)."""
    rows, kind = topic_source.records(records).select("ts_ms", "value"), job.source.data_type
    if kind is DataType.PROTOBUF:
        return rows
    return codecs.decode_records(rows, kind, job.conversion.on_error, "value")


def read(spark: SparkSession, job: Job, env: Environment, require: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """The source as rows (ts_ms, value). Values are bytes for protobuf, else the decoded type.

    ``listing`` is what ``input_listing`` gave, if it was taken already.
    """
    if job.source.platform is not Platform.KAFKA:
        return _read_files(spark, job, env, listing).select(F.lit(None).cast("bigint").alias("ts_ms"), "value")
    return _messages(topic_source.read(env.topics[job.source.options["topic"]], _bounds(job), require), job)


def _file_range(job: Job) -> file_source.FileRange:
    options = job.source.options
    prefixes = options.get("objectNamePrefixes" if job.source.platform is Platform.S3 else "prefixes") or ()
    return file_source.FileRange(tuple(prefixes), options.get("from"), options.get("to"))


def input_listing(spark: SparkSession, job: Job, env: Environment) -> DataFrame:
    """The files or objects a job reads; finding none is an error.

    With ``hiddenNames`` those with any name and size, else those that Spark's readers see.
    """
    options = job.source.options
    every = bool(options.get("hiddenNames", False))
    if job.source.platform is Platform.S3:
        return file_source.list_objects(spark, env.buckets[options["bucket"]], _file_range(job), every)
    recursive = bool(options.get("recursive", False))
    return file_source.scan_tree(spark, options["parentPath"], _file_range(job), recursive, every)


def _read_files(spark: SparkSession, job: Job, env: Environment, listing: DataFrame | None) -> DataFrame:
    wanted, options = _file_range(job), job.source.options
    if listing is None:
        listing = input_listing(spark, job, env)
    if options.get("hiddenNames", False):
        if job.source.data_type is not DataType.JSON:
            raise SpecError("hiddenNames is for files of JSON arrays")
        return file_source.read_listed_arrays(listing)
    if job.source.platform is Platform.S3:
        root = env.buckets[options["bucket"]]
        return file_source.read_objects(root, wanted, lambda path, times: _read_path(spark, job, path, times, True))
    path = options["parentPath"]
    if file_source.is_file(listing, path):
        wanted = file_source.FileRange()
    return _read_path(spark, job, path, wanted, bool(options.get("recursive", False)))


def _read_path(spark: SparkSession, job: Job, path: str, wanted: file_source.FileRange, recursive: bool) -> DataFrame:
    if job.source.data_type is DataType.JSON:
        # Files known to hold one element per line can be split; others are parsed one file at a time.
        by_line = bool(job.source.options.get("elementPerLine", False))
        read_arrays = file_source.read_json_array_lines if by_line else file_source.read_json_arrays
        return read_arrays(spark, path, wanted, recursive)
    proto = job.conversion.protos.get(job.source.message)
    messages = file_source.read_messages(spark, path, proto.schema(), wanted, recursive)
    struct = F.struct(*[F.col(f"`{c}`") for c in proto.schema().names])
    return messages.select(protobuf.encode(struct, proto).alias("value"))


def write(rows: DataFrame, job: Job, env: Environment, folder: str = "", replace: bool = False) -> None:
    """Rows to the sink as they come: every task is a worker, nothing is shuffled."""
    options, kind = job.sink.options, job.sink.data_type
    if env.limit_workers:
        rows = limit_workers(rows, job.parallelism)
    if job.sink.platform is Platform.KAFKA:
        if kind is not DataType.PROTOBUF:
            rows = rows.withColumn("value", codecs.encode(kind, F.col("value")))
        topic = options["topic"]
        placed = topic_sink.assign_partitions(rows, int(options["batchSize"]), list(env.topic_partitions[topic]))
        env.topic_sinks[topic](topic_sink.to_records(placed, topic))
        return
    limits = options.get("fileSegmentator") or {}
    size, count = limits.get("maxSizePerFile"), limits.get("maxElementsPerFile")
    root, layout = options.get("parentPath") or options.get("dir"), "flat"
    if job.sink.platform is Platform.S3:
        root, layout = env.buckets[options["bucket"]], "object"
    root = f"{root.rstrip('/')}/{folder}" if folder else root
    if kind is DataType.JSON:
        content, file_format = rows.select("value"), "json"
    else:
        proto = job.conversion.protos.get(job.sink.message)
        # The encoded message is the size estimate; the file then holds the message's own columns.
        sized = rows.select(json_element_cost(F.col("value")).alias(file_sink.SIZE_COLUMN), "value")
        messages = sized.withColumn("message", protobuf.decode(F.col("value"), proto))
        content, file_format = messages.select(file_sink.SIZE_COLUMN, "message.*"), "parquet"
    file_sink.write_as_they_come(content, root, job.job_id, file_format, size, count, layout, replace)


def _converted(rows: DataFrame, job: Job, skipped: Observation | None = None) -> DataFrame:
    rows = convert(rows, job.converter)
    if job.conversion.on_error != "skip":
        return rows
    bad = F.col("value").isNull()
    if skipped is not None:
        rows = rows.observe(skipped, F.count_if(bad).alias("n"))
    return rows.filter(~bad)


def _is_observed(rows: DataFrame) -> bool:
    """Whether a run of ``rows`` observes anything: planning drops the counters of input it finds empty."""
    return "CollectMetrics" in rows._jdf.queryExecution().optimizedPlan().toString()


class _Record:
    """What a run tells its audit log, if it has one."""

    def __init__(self, log: audit.AuditLog | None, job: Job) -> None:
        self.log, self.job = log, job

    def created(self) -> None:
        if self.log is None:
            return
        job, now = self.job, datetime.now(timezone.utc)
        self.log.job(
            job.job_id,
            parallelism=job.parallelism,
            source_type=job.source.platform.name,
            sink_type=job.sink.platform.name,
            source_data_type=job.source.data_type.name,
            sink_data_type=job.sink.data_type.name,
            special_converter_name=job.conversion.converter,
            special_converter_subtype=job.conversion.converter_type,
            special_converter_args=",".join(job.conversion.args) or None,
            creation_time=now,
            start_time=now,
        )
        self._workers(audit.STARTED)

    def _workers(self, state: str, error: str | None = None) -> None:
        events = [{"worker_type": t, "worker_state": state, "thread_num": 0, "error": error} for t in ("source", "sink")]
        self.log.workers(self.job.job_id, events)

    def failed(self, error: Exception) -> None:
        if self.log is None:
            return
        text = str(error)
        self.log.job(self.job.job_id, error=text, finish_time=datetime.now(timezone.utc))
        self._workers(audit.ERROR, text)

    def finished(self, counters: Mapping[str, int]) -> None:
        if self.log is None:
            return
        self.log.job(self.job.job_id, finish_time=datetime.now(timezone.utc))
        self._workers(audit.FINISHED)
        self.log.counters(self.job.job_id, "source", dict(counters))


def run(spark: SparkSession, spec: Mapping[str, Any], env: Environment, log: audit.AuditLog | None = None, **conversion: Any) -> Job:
    """Resolve, read, convert and write one job, and record it in ``log``."""
    job = resolve(spec, env, **conversion)
    record, seen, skipped = _Record(log, job), Observation("read"), Observation("skipped")
    record.created()
    try:
        counters, listing = {}, None
        if log is not None and job.source.platform is not Platform.KAFKA:
            # Counted before anything is written, as the job's own files may lie below the same path.
            name = audit.READ_OBJECTS if job.source.platform is Platform.S3 else audit.READ_FILES
            listing = input_listing(spark, job, env)
            counters[name] = listing.count()
        rows = read(spark, job, env, listing=listing).observe(seen, F.count(F.lit(1)).alias("n"))
        converted = _converted(rows, job, skipped)
        observed = _is_observed(converted)
        write(converted, job, env)
        if log is not None:
            counters[audit.READ_RECORDS] = int(seen.get["n"]) if observed else 0
            if job.conversion.on_error == "skip":
                counters[audit.SKIPPED_RECORDS] = int(skipped.get["n"]) if observed else 0
    except Exception as error:
        record.failed(error)
        raise
    record.finished(counters)
    return job


def run_available_now(
    spark: SparkSession,
    spec: Mapping[str, Any],
    env: Environment,
    checkpoint: str,
    log: audit.AuditLog | None = None,
    **conversion: Any,
) -> Job:
    """The same job over a streaming topic: it drains what is there now and stops; a rerun goes on from there.

    A TIME range is told record by record, see ``streaming.time_range``. File sinks get one folder per micro-batch. The
    job's id comes from the checkpoint's path, so a batch that is run again finds the files it wrote before and replaces
    them. Records are counted batch by batch beside the checkpoint, those of the range and those left out as bad, so the
    counters of a run that was resumed are those of the whole job.
    """
    job = resolve(spec, env, **conversion)
    job.job_id = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex
    if job.source.platform is not Platform.KAFKA:
        raise SpecError("a streaming run reads a topic")
    record, bounds = _Record(log, job), _bounds(job)
    record.created()
    polls = Ledger(spark, checkpoint, "polls", "number long, n_read long, n_skipped long")

    def write_batch(batch: DataFrame, number: int) -> None:
        seen, skipped = Observation(f"read-{number}"), Observation(f"skipped-{number}")
        converted = _converted(batch.observe(seen, F.count(F.lit(1)).alias("n")), job, skipped)
        observed = _is_observed(converted)
        write(converted, job, env, str(number), replace=True)
        left_out = int(skipped.get["n"]) if observed and job.conversion.on_error == "skip" else 0
        n_read = int(seen.get["n"]) if observed else 0
        polls.write(number, spark.createDataFrame([(number, n_read, left_out)], polls.schema))

    try:
        if bounds.kind is topic_source.RangeType.TIME:
            topic = env.topics[job.source.options["topic"]]
            stream = topic if isinstance(topic, DataFrame) else topic(bounds)
            drain_time_range(stream, bounds, checkpoint, lambda batch, number: write_batch(_messages(batch, job), number))
        else:
            available_now.drain_to_batches(read(spark, job, env, require=False), checkpoint, write_batch)
    except Exception as error:
        record.failed(error)
        raise
    counted = polls.read_all()
    last = counted.orderBy(F.col("number").desc()).head()
    totals = counted.agg(F.sum("n_read").alias("n"), F.count_if(F.col("n_read") == 0).alias("empty"), F.sum("n_skipped").alias("skipped")).head()
    counters = audit.poll_totals(totals["n"] or 0, totals["empty"], last["n_read"] if last else 0)
    if job.conversion.on_error == "skip":
        counters[audit.SKIPPED_RECORDS] = totals["skipped"] or 0
    record.finished(counters)
    return job
