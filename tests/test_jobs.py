"""Run audit, job descriptions and whole jobs."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferryline import EmptyRangeError, SpecError
from ferryline.operators import audit, bundled_protos, protobuf
from ferryline.plans import job as jobs
from ferryline.sources import files as file_source

# --- audit -------------------------------------------------------------------------------------------------


def test_run_history(spark, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path))
    log.job("a", parallelism=4, source_type="KAFKA", sink_type="S3", queued=False)
    log.job("b", parallelism=1)
    log.job("a", error=None, queue_size=7)
    log.error("a", "broken")
    log.workers("a", [{"worker_type": "source", "worker_state": audit.STARTED, "thread_num": 0}] * 2)
    log.counters("a", "source", {"x": 1, "y": 2})
    log.counters("a", "sink", {"x": 5})
    log.counters("a", "sink", {})
    rows = {r.job_id: r for r in log.current().collect()}
    assert (rows["a"].parallelism, rows["a"].queue_size, rows["a"].error, rows["a"].sink_type) == (4, 7, "broken", "S3")
    assert rows["b"].error is None and len(rows) == 2
    merged = audit.merge_counters(log.table("counters")).collect()
    assert {(r.name, r.counter_val) for r in merged} == {("x", 5), ("y", 2)}
    found = audit.lookup(log.table("job"), log.table("worker_event"), log.table("counters"), "a").collect()
    assert sorted((r.kind, r.name, r.state, r.counter_val) for r in found if r.kind == "worker_event") == [
        ("worker_event", "source-0", "STARTED", None)
    ]
    assert sorted((r.name, r.counter_val) for r in found if r.kind == "counter") == [("x", 1), ("x", 5), ("y", 2)]
    alone = audit.lookup(log.table("job"), log.table("worker_event"), log.table("counters"), "b").collect()
    assert len(alone) == 1 and alone[0].kind is None


def test_reports(spark):
    slots = spark.createDataFrame([(1, 2, 3, 4, 5, 6), (10, 20, 30, 40, 50, 60)], list(audit.CAPACITY_COLUMNS))
    assert tuple(audit.capacity(slots).head()) == (11, 22, 33, 44, 55, 66)
    instances = spark.createDataFrame([("i1", ["a", "b"]), ("i2", ["c"]), ("i3", [])], "instance string, jobs array<string>")
    assert sorted(map(tuple, audit.running_jobs(instances).collect())) == [("i1", "a"), ("i1", "b"), ("i2", "c")]
    assert [r.instance for r in audit.holder_of(instances, "c").collect()] == ["i2"]
    entries = spark.createDataFrame([("k", 1, "x"), ("k", 3, "z"), ("k", 2, "y"), ("l", 1, "w")], "key string, ord int, v string")
    assert sorted(map(tuple, audit.merge_latest(entries, "key", ["v"], ["ord"]).collect())) == [("k", "z"), ("l", "w")]


def test_counters_per_task(spark):
    rows = spark.range(0, 10, 1, 2)
    assert {(r.name, r.counter_val) for r in audit.counters_by_worker(rows).collect()} == {("0_read_records", 5), ("1_read_records", 5)}


# --- descriptions ------------------------------------------------------------------------------------------


def spec(source="KAFKA", sink="S3", source_type="json", sink_type="json", **more):
    sections = {
        "kafkaSource": {"from": 0, "to": 100, "rangeType": "OFFSET", "topic": "in"},
        "s3Source": {"bucket": "src", "objectNamePrefixes": None},
        "hdfsSource": {"parentPath": "/in", "recursive": True},
        "kafkaSink": {"batchSize": 2, "topic": "out"},
        "s3Sink": {"bucket": "dst"},
        "hdfsSink": {"parentPath": "/out"},
        "localSink": {"dir": "/out"},
    }
    message = {"protobuf": "Sensor"}
    full = {
        "parallelism": 2,
        "sourceGeneral": {"platform": source, "dataType": {"type": source_type, "specificType": message.get(source_type)}},
        "sinkGeneral": {"platform": sink, "dataType": {"type": sink_type, "specificType": message.get(sink_type)}},
        **sections,
    }
    full.update(more)
    return full


@pytest.fixture
def env(spark, tmp_path):
    values = [json.dumps({"name": f"s{i}", "humidity": i % 3}) for i in range(20)]
    rows = spark.createDataFrame([(i % 2, i, i * 1000, v) for i, v in enumerate(values)], "p int, o bigint, ms bigint, v string")
    topic = rows.select(
        F.lit(None).cast("binary").alias("key"), F.col("v").cast("binary").alias("value"), F.lit("in").alias("topic"),
        F.col("p").alias("partition"), F.col("o").alias("offset"), F.timestamp_millis("ms").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
    proto = bundled_protos.bundled().get("Sensor")
    binary = topic.withColumn("value", protobuf.json_to_bytes(F.col("value").cast("string"), proto))
    for name in ("src", "dst"):
        (tmp_path / name).mkdir()
    return jobs.Environment(
        topics={"in": topic, "protos": binary},
        topic_sinks={"out": lambda records: records.write.parquet(str(tmp_path / "out-topic"))},
        topic_partitions={"out": [0, 1, 2]},
        buckets={name: str(tmp_path / name) for name in ("src", "dst")},
    )


@pytest.mark.parametrize(
    "change, text",
    [
        ({"source": "FTP"}, "does not exist"),
        ({"source": "LOCAL_FS"}, "no source part"),
        ({"source": "S3", "source_type": "long"}, "does not support"),
        ({"sink_type": "decimal"}, "not supported"),
        ({"sink_type": "protobuf", "sinkGeneral": {"platform": "S3", "dataType": {"type": "protobuf", "specificType": "Nope"}}}, "not registered"),
        ({"kafkaSource": None}, "has not been supplied"),
        ({"sourceGeneral": None}, "missing"),
        ({"parallelism": 0}, "parallelism"),
        ({"kafkaSource": {"from": 0, "to": 1, "rangeType": "DAYS", "topic": "in"}}, "range type"),
        ({"kafkaSource": {"from": 0, "to": 1, "rangeType": "TIME", "topic": "zz"}}, "does not exist"),
        ({"sink": "KAFKA", "kafkaSink": {"batchSize": 2, "topic": "zz"}}, "does not exist"),
        ({"sink": "KAFKA", "kafkaSink": {"batchSize": 0, "topic": "out"}}, "batch size"),
        ({"s3Sink": {"bucket": "zz"}}, "bucket"),
        ({"sink": "LOCAL_FS"}, "local folder"),
        ({"source_type": "string", "sink_type": "json"}, "no converter from"),
        ({"source_type": "protobuf", "specialConverter": {"name": "nope"}}, "no converter is named"),
        ({"source_type": "protobuf", "specialConverter": {"name": "proto-flat-json", "specificType": "zz"}}, "known specific type"),
    ],
)
def test_refused_before_reading(env, change, text):
    with pytest.raises(SpecError, match=text):
        jobs.resolve(spec(**change), env)


# --- whole jobs --------------------------------------------------------------------------------------------


def names_in(spark, folder):
    read = file_source.read_json_arrays(spark, str(folder))
    return sorted(r[0] for r in read.select(F.get_json_object("value", "$.name")).collect())


def test_topic_to_bucket_with_audit(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    done = jobs.run(spark, spec(kafkaSource={"from": 12, "to": 3, "rangeType": "OFFSET", "topic": "in"}), env, log)
    assert names_in(spark, tmp_path / "dst") == sorted(f"s{i}" for i in range(3, 13))
    assert all(f.startswith(done.job_id) and "." not in f for f in os.listdir(tmp_path / "dst"))
    row = log.current().head()
    assert row.finish_time is not None and row.error is None and row.source_type == "KAFKA" and row.sink_data_type == "JSON"
    assert [(r.name, r.counter_val) for r in log.table("counters").collect()] == [("_read_records", 10)]


def test_file_counters_and_worker_events(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    for n in range(3):
        (tmp_path / "src" / f"{n}.json").write_text('[{"name":"a"},{"name":"b"}]')
    env.limit_workers = True
    jobs.run(spark, spec(source="S3", parallelism=1), env, log)
    assert {(r.name, r.counter_val) for r in log.table("counters").collect()} == {("_read_records", 6), ("_read_objects", 3)}
    assert {r.worker_state for r in log.table("worker_event").collect()} == {"STARTED", "FINISHED"}
    assert len(os.listdir(tmp_path / "dst")) == 1


def test_run_without_rows(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    env.topics = {"in": env.topics["in"].filter("offset = 0")}
    # The first record lies past the end but in the second of the start: the range counts as met, and is empty.
    env.topics["in"] = env.topics["in"].withColumn("timestamp", F.timestamp_millis(F.lit(5900)))
    jobs.run(spark, spec(kafkaSource={"from": 5000, "to": 5500, "rangeType": "TIME", "topic": "in"}), env, log)
    assert os.listdir(tmp_path / "dst") == []
    assert [(r.name, r.counter_val) for r in log.table("counters").collect()] == [("_read_records", 0)]


def test_streaming_run(spark, env, tmp_path):
    env.topics["in"].drop("timestamp").write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(env.topics["in"].drop("timestamp").schema).parquet(str(tmp_path / "feed"))
    env.topics = {"in": stream.withColumn("timestamp", F.timestamp_millis(F.col("offset") * 1000))}
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    ranged = spec(kafkaSource={"from": 3, "to": 12, "rangeType": "OFFSET", "topic": "in"})
    for _ in range(2):
        jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"), log)
        assert names_in(spark, tmp_path / "dst") == sorted(f"s{i}" for i in range(3, 13))
    counters = [(r.name, r.counter_val) for r in log.table("counters").collect()]
    # The second run finds nothing new; its counters are still those of the whole job.
    assert sorted(v for n, v in counters if n == "_read_records") == [10, 10]
    assert ("_empty_polls", 0) in counters
    with pytest.raises(SpecError, match="streaming run"):
        jobs.run_available_now(spark, spec(source="HDFS"), env, str(tmp_path / "check2"))


def test_streaming_run_over_a_time_range(spark, env, tmp_path):
    small_batches(spark, env, tmp_path / "feed", 1)
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    ranged = spec(kafkaSource={"from": 3000, "to": 12_000, "rangeType": "TIME", "topic": "in"})
    for _ in range(2):
        jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"), log)
        assert names_in(spark, tmp_path / "dst") == sorted(f"s{i}" for i in range(3, 13))
    assert {r.counter_val for r in log.table("counters").filter("name = '_read_records'").collect()} == {10}


def test_counters_of_a_resumed_run_are_those_of_the_whole_job(spark, env, tmp_path, monkeypatch):
    small_batches(spark, env, tmp_path / "feed", 6)
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    ranged = spec(kafkaSource={"from": 3, "to": 14, "rangeType": "OFFSET", "topic": "in"})
    whole, calls = jobs.write, []

    def failing(rows, job, env, folder="", replace=False):
        calls.append(folder)
        whole(rows, job, env, folder, replace)
        if folder == "3" and calls.count("3") == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "write", failing)
    with pytest.raises(Exception, match="lost"):
        jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"), log)
    for _ in range(2):
        jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"), log)
        assert names_in(spark, tmp_path / "dst") == sorted(f"s{i}" for i in range(3, 15))
    counted = log.table("counters").filter("name = '_read_records'").collect()
    assert [r.counter_val for r in counted] == [12, 12] and calls.count("3") == 2


def test_poll_counters():
    assert audit.poll_counters([5, 0, 7]) == {"_read_records": 12, "_empty_polls": 1, "last_poll_size": 7}
    assert audit.poll_counters([])["_read_records"] == 0


def small_batches(spark, env, folder, files):
    """A streaming topic that is read one small file a micro-batch."""
    feed = env.topics["in"].drop("timestamp").repartition(files, "offset")
    feed.write.parquet(str(folder))
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    env.topics = {"in": stream.withColumn("timestamp", F.timestamp_millis(F.col("offset") * 1000))}


def test_a_batch_that_is_run_again_replaces_its_files(spark, env, tmp_path):
    small_batches(spark, env, tmp_path / "feed", 6)
    ranged = spec(kafkaSource={"from": 3, "to": 14, "rangeType": "OFFSET", "topic": "in"})
    want = sorted(f"s{i}" for i in range(3, 15))
    jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"))
    assert names_in(spark, tmp_path / "dst") == want
    commits = tmp_path / "check" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for path in commits.glob(f"*{last}*"):
        if path.name in (str(last), f".{last}.crc"):
            path.unlink()
    jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"))
    assert names_in(spark, tmp_path / "dst") == want


def test_stream_counters_are_exact_beyond_the_progress_buffer(spark, env, tmp_path):
    small_batches(spark, env, tmp_path / "feed", 9)
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        ranged = spec(kafkaSource={"from": 3, "to": 14, "rangeType": "OFFSET", "topic": "in"})
        jobs.run_available_now(spark, ranged, env, str(tmp_path / "check"), log)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert ("_read_records", 12) in [(r.name, r.counter_val) for r in log.table("counters").collect()]


def test_a_topic_sink_needs_its_partitions(env):
    env.topic_partitions = {}
    with pytest.raises(SpecError, match="partitions"):
        jobs.resolve(spec(sink="KAFKA", source_type="string", sink_type="string"), env)


def test_error_texts_are_kept_whole(spark, env, tmp_path, monkeypatch):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))

    def fail(*_):
        raise RuntimeError("x" * 5000)

    monkeypatch.setattr(jobs, "write", fail)
    with pytest.raises(RuntimeError):
        jobs.run(spark, spec(), env, log)
    assert len(log.current().head().error) == 5000


def test_failed_run_is_recorded(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    with pytest.raises(EmptyRangeError):
        jobs.run(spark, spec(kafkaSource={"from": 10**9, "to": 10**9, "rangeType": "TIME", "topic": "in"}), env, log)
    row = log.current().head()
    assert "no partition" in row.error and row.finish_time is not None


def test_proto_topic_to_flat_json_folder(spark, env, tmp_path):
    env.local_allowed = True
    jobs.run(
        spark,
        spec(
            sink="LOCAL_FS",
            source_type="protobuf",
            kafkaSource={"from": 0, "to": 10**6, "rangeType": "TIME", "topic": "protos"},
            localSink={"dir": str(tmp_path / "flat"), "fileSegmentator": {"maxSizePerFile": "1 kb", "maxElementsPerFile": 4}},
            specialConverter={"name": "proto-flat-json", "specificType": "sensor_flatted"},
        ),
        env,
    )
    read = file_source.read_json_arrays(spark, str(tmp_path / "flat"))
    got = sorted(r[0] for r in read.select(F.get_json_object("value", "$.name_new")).collect())
    assert got == sorted(f"s{i}" for i in range(20))
    assert read.filter(F.get_json_object("value", "$.humidity_new") == "0").count() == 7


def test_json_topic_to_parquet_and_on_to_a_topic(spark, env, tmp_path):
    jobs.run(spark, spec(sink="HDFS", sink_type="protobuf", hdfsSink={"parentPath": str(tmp_path / "pq"), "fileSegmentator": {"maxElementsPerFile": 6}}), env)
    files = [f for f in os.listdir(tmp_path / "pq") if f.endswith(".parquet")]
    assert files and spark.read.parquet(str(tmp_path / "pq")).count() == 20
    jobs.run(spark, spec(source="HDFS", sink="KAFKA", source_type="protobuf", sink_type="protobuf", hdfsSource={"parentPath": str(tmp_path / "pq")}), env)
    sent = spark.read.parquet(str(tmp_path / "out-topic"))
    proto = bundled_protos.bundled().get("Sensor")
    back = sent.select("partition", "headers", protobuf.decode(F.col("value"), proto).alias("m")).collect()
    assert sorted(r.m.name for r in back) == sorted(f"s{i}" for i in range(20))
    assert {r.partition for r in back} <= {0, 1, 2} and all(r.headers is None for r in back)


def test_topic_copy_keeps_time(spark, env, tmp_path):
    jobs.run(spark, spec(sink="KAFKA", source_type="string", sink_type="string"), env)
    sent = spark.read.parquet(str(tmp_path / "out-topic")).collect()
    assert len(sent) == 20
    times = sorted(int(r.headers[0]["value"]) for r in sent if r.headers)
    assert times == [i * 1000 for i in range(1, 20)]


def test_bucket_with_overlapping_prefixes_is_read_twice(spark, env, tmp_path):
    (tmp_path / "src" / "2023-a.json").write_text('[{"name":"a"}]')
    (tmp_path / "src" / "2023-b.json").write_text('[{"name":"b"}]')
    jobs.run(spark, spec(source="S3", s3Source={"bucket": "src", "objectNamePrefixes": ["2023", "2023-b"]}), env)
    assert names_in(spark, tmp_path / "dst") == ["a", "b", "b"]


def test_element_per_line(spark, env, tmp_path):
    (tmp_path / "src" / "x.json").write_text('[\n{"name":"a"},\n{"name":"b"}\n]')
    jobs.run(spark, spec(source="S3", s3Source={"bucket": "src", "elementPerLine": True}), env)
    assert names_in(spark, tmp_path / "dst") == ["a", "b"]


def test_skipping_bad_values(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    (tmp_path / "src" / "x.json").write_text('[{"name":"a"},{"humidity":"wet"},{"name":"b"}]')
    jobs.run(spark, spec(source="S3", sink="HDFS", sink_type="protobuf", hdfsSink={"parentPath": str(tmp_path / "pq")}), env, log, on_error="skip")
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "pq")).collect()) == ["a", "b"]
    assert ("_skipped_records", 1) in {(r.name, r.counter_val) for r in log.table("counters").collect()}
    with pytest.raises(PySparkException):
        jobs.run(spark, spec(source="S3", sink="HDFS", sink_type="protobuf", hdfsSink={"parentPath": str(tmp_path / "pq2")}), env)


def test_files_of_any_name_are_read_and_counted_from_one_listing(spark, env, tmp_path):
    log = audit.AuditLog(spark, str(tmp_path / "audit"))
    for name in ("_a.json", "deep/.b.json", "c.json"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f'[{{"name":"{path.stem}"}}]')
    folder = {"parentPath": str(tmp_path / "in"), "recursive": True, "hiddenNames": True}
    jobs.run(spark, spec(source="HDFS", hdfsSource=folder), env, log)
    assert names_in(spark, tmp_path / "dst") == [".b", "_a", "c"]
    assert ("_read_files", 3) in {(r.name, r.counter_val) for r in log.table("counters").collect()}
    with pytest.raises(SpecError, match="JSON arrays"):
        jobs.run(spark, spec(source="HDFS", source_type="protobuf", hdfsSource=folder), env)
