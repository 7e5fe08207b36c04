"""Range rules of topic reads, with the reference cases: offsets 1..4 in three partitions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ferryline import EmptyRangeError, SpecError
from ferryline.sources import topic
from ferryline.sources.topic import RangeType, RecordRange
from ferryline.streaming.time_range import TimeGate


def make_topic(spark, rows):
    """rows: (partition, offset, ms)."""
    schema = "partition int, offset bigint, ms bigint"
    return spark.createDataFrame(rows, schema).select(
        F.lit(None).cast("binary").alias("key"),
        F.col("offset").cast("string").cast("binary").alias("value"),
        F.lit("t").alias("topic"),
        "partition",
        "offset",
        F.timestamp_millis("ms").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def positions(df):
    return sorted((r.partition, r.offset) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    return make_topic(spark, [(p, o, o * 100) for p in range(3) for o in range(1, 5)])


def test_bounds_are_swapped():
    assert RecordRange(9, 2) == RecordRange(2, 9)


def test_unknown_range_type():
    with pytest.raises(SpecError):
        RangeType.parse("DAYS")
    assert RangeType.parse("time") is RangeType.TIME


@pytest.mark.parametrize(
    "start, end, offsets",
    [(1, 3, [1, 2, 3]), (0, 2, [1, 2]), (0, 1, [1]), (2, 9, [2, 3, 4]), (3, 3, [3]), (4, 2, [2, 3, 4])],
)
def test_offset_range_is_inclusive(small, start, end, offsets):
    assert positions(topic.read(small, RecordRange(start, end))) == [(p, o) for p in range(3) for o in offsets]


def test_offset_range_before_the_log_is_an_error(small):
    with pytest.raises(EmptyRangeError):
        topic.read(small, RecordRange(-5, 0))


def test_offset_resolution(spark):
    rows = topic.resolve_offsets(make_topic(spark, [(0, 5, 1), (1, 2, 1), (2, 9, 1)]), RecordRange(4, 8)).collect()
    assert {(r.partition, r.start_offset, r.stop_offset, r.qualifies) for r in rows} == {
        (0, 5, 9, True), (1, 4, 9, True), (2, 9, 9, False)
    }


def test_one_partition_out_the_others_in(spark):
    data = make_topic(spark, [(0, 10, 1), (1, 1, 1), (1, 2, 1)])
    assert positions(topic.read(data, RecordRange(1, 5))) == [(1, 1), (1, 2)]


def test_time_range(small):
    got = positions(topic.read(small, RecordRange(200, 300, RangeType.TIME)))
    assert got == [(p, o) for p in range(3) for o in (2, 3)]


def test_no_record_late_enough(small):
    with pytest.raises(EmptyRangeError):
        topic.read(small, RecordRange(500, 900, RangeType.TIME))


def test_first_record_past_the_end(spark):
    data = make_topic(spark, [(0, 1, 100), (0, 2, 9000)])
    with pytest.raises(EmptyRangeError):
        topic.read(data, RecordRange(2000, 3000, RangeType.TIME))


def test_same_second_as_the_start_takes_part_but_gives_no_rows(spark):
    data = make_topic(spark, [(0, 1, 100), (0, 2, 2900)])
    bounds = RecordRange(2000, 2500, RangeType.TIME)
    assert topic.resolve_times(data, bounds).head().qualifies
    assert positions(topic.read(data, bounds)) == []


def test_reading_stops_at_the_first_late_record(spark):
    times = [100, 250, 120, 300, 900, 260, 280]
    data = make_topic(spark, [(0, o, t) for o, t in enumerate(times)])
    # Starts at 250, keeps the early 120, stops before 900 and never reaches 260 and 280.
    assert positions(topic.read(data, RecordRange(200, 400, RangeType.TIME))) == [(0, 1), (0, 2), (0, 3)]


def scan(rows, low, high):
    """The rule as a loop over one partition."""
    kept, started = [], False
    for offset, ms in sorted(rows):
        if not started:
            if ms < low:
                continue
            if ms // 1000 != low // 1000 and ms > high:
                return []
            started = True
        if ms > high:
            break
        kept.append(offset)
    return kept


def test_time_range_against_a_scan(spark):
    rng = random.Random(3)
    rows = [(p, o * 2 + p, rng.randrange(0, 9000)) for p in range(12) for o in range(40)]
    data = make_topic(spark, rows).repartition(5)
    for low, high in [(1000, 8500), (4000, 4500), (0, 8999), (8000, 8990)]:
        want = [
            (p, o) for p in range(12) for o in scan([(o, t) for q, o, t in rows if q == p], low, high)
        ]
        got = positions(topic.read(data, RecordRange(low, high, RangeType.TIME), require=False))
        assert got == sorted(want)


def test_time_range_without_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(topic, "collect_if_short", lambda df: None)
    got = positions(topic.read(small, RecordRange(200, 300, RangeType.TIME)))
    assert got == [(p, o) for p in range(3) for o in (2, 3)]


def test_time_range_does_not_shuffle_the_topic(small):
    plan = topic.read(small, RecordRange(200, 300, RangeType.TIME))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_records_keep_positive_times_only(spark):
    rows = topic.records(make_topic(spark, [(0, 1, 100), (0, 2, -1), (0, 3, 0)])).collect()
    assert {r.offset: r.ts_ms for r in rows} == {1: 100, 2: None, 3: None}
    assert "key" not in rows[0].asDict()


def test_offset_tracker(spark, small):
    read = topic.read(small, RecordRange(2, 3)).filter("partition <> 2")
    got = {tuple(r) for r in topic.offset_tracker(read, small).collect()}
    assert got == {(0, 2, 200, 3, 300), (1, 2, 200, 3, 300), (2, -1, -1, -1, -1)}


def test_reader_options():
    options = topic.offset_options("t", RecordRange(4, 8), {0: 5, 1: 2, 2: 9}, {0: 7, 1: 20, 2: 30})
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 5, "1": 4, "2": 30}}
    assert json.loads(options["endingOffsets"]) == {"t": {"0": 7, "1": 9, "2": 30}}
    with pytest.raises(EmptyRangeError):
        topic.offset_options("t", RecordRange(0, 3), {0: 5}, {0: 9})
    options = topic.time_options("t", RecordRange(4, 8, RangeType.TIME), [0, 1])
    assert json.loads(options["startingOffsetsByTimestamp"]) == {"t": {"0": 4, "1": 4}}
    assert json.loads(options["endingOffsetsByTimestamp"]) == {"t": {"0": 9, "1": 9}}
    options = topic.time_options("t", RecordRange(4, 8, RangeType.TIME))
    assert (options["startingTimestamp"], options["endingTimestamp"]) == ("4", "9")


def test_broker_ends_are_the_range(spark):
    """First offsets that reach the start and that pass the end bound the same rows as the rule."""
    rng = random.Random(5)
    rows = [(p, o, rng.randrange(0, 9000)) for p in range(6) for o in range(40)]
    data = make_topic(spark, rows)
    for low, high in [(1000, 8500), (4000, 4500), (8000, 8990)]:
        want = []
        for p in range(6):
            mine = [(o, t) for q, o, t in rows if q == p]
            start = min((o for o, t in mine if t >= low), default=10**9)
            stop = min((o for o, t in mine if t >= high + 1), default=10**9)
            want += [(p, o) for o, _ in mine if start <= o < stop]
        assert positions(topic.read(data, RecordRange(low, high, RangeType.TIME), require=False)) == sorted(want)


def test_opened_topics(spark, small, monkeypatch):
    seen = []
    monkeypatch.setattr(topic, "open_topic", lambda s, servers, options: seen.append(options) or small.limit(2))
    opener = topic.kafka_topic(spark, "b:1", "t", lambda: ({0: 1}, {0: 5}))
    assert topic.read(opener, RecordRange(2, 3)).count() == 2
    assert topic.read(opener, RecordRange(2, 3, RangeType.TIME)).count() == 2
    assert "startingOffsets" in seen[0] and seen[1]["endingTimestamp"] == "4"
    with pytest.raises(EmptyRangeError):
        topic.read(lambda bounds: small.limit(0), RecordRange(2, 3))
    with pytest.raises(SpecError):
        topic.kafka_topic(spark, "b:1", "t")(RecordRange(2, 3))


def test_timestamps_are_utc(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "timestamp timestamp_ntz")
    assert row.select(topic.timestamp_ms()).head()[0] == 1704067200000


def test_stream_offsets():
    progress = {"sources": [{"endOffset": '{"t": {"0": 5, "1": 7}}'}, {"endOffset": {"u": {"0": 2}}}, {"endOffset": None}]}
    assert topic.stream_offsets(progress) == {"t": {0: 5, 1: 7}, "u": {0: 2}}


# --- time ranges of streams ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_a_time_gate_over_batches_equals_the_range_of_the_topic(spark, tmp_path, seed):
    """Records in any order of time, cut into batches at any offset; a batch comes twice and a new gate goes on."""
    draw = random.Random(seed)
    rows = [(p, o, draw.randrange(0, 9000)) for p in range(5) for o in sorted(draw.sample(range(200), 30))]
    bounds = RecordRange(draw.randrange(500, 3000), draw.randrange(5000, 8900), RangeType.TIME)
    whole = make_topic(spark, rows)
    cuts = sorted(draw.sample(range(200), 3))
    got = []
    for number, (low, high) in enumerate(zip([0, *cuts], [*cuts, 200])):
        batch = whole.filter(F.col("offset").between(low, high - 1)).repartition(3)
        gate = TimeGate(spark, bounds, str(tmp_path / "check"))
        first = positions(gate.admit(batch, number))
        assert positions(gate.admit(batch, number)) == first
        got += first
    assert sorted(got) == positions(topic.read_times(whole, bounds))


def test_an_empty_batch_keeps_what_is_known(spark, tmp_path):
    gate = TimeGate(spark, RecordRange(100, 200, RangeType.TIME), str(tmp_path / "check"))
    none = make_topic(spark, [(0, 0, 0)]).limit(0)
    assert positions(gate.admit(make_topic(spark, [(0, 1, 150), (1, 1, 50)]), 0)) == [(0, 1)]
    assert positions(gate.admit(none, 1)) == []
    assert positions(gate.admit(make_topic(spark, [(0, 2, 20), (0, 3, 250), (0, 4, 150), (1, 2, 120)]), 2)) == [(0, 2), (1, 2)]
    assert positions(gate.admit(make_topic(spark, [(0, 5, 150), (1, 3, 10)]), 3)) == [(1, 3)]


def test_a_stream_begins_where_its_range_does():
    assert topic.stream_start("t", RecordRange(5, 9, RangeType.TIME)) == {
        "startingTimestamp": "5", "startingOffsetsByTimestampStrategy": "latest",
    }
    assert topic.stream_start("t", RecordRange(5, 9)) == {}
    starts = topic.stream_start("t", RecordRange(5, 9), {0: 0, 1: 7, 2: 0}, {0: 20, 1: 8, 2: 3})
    assert json.loads(starts["startingOffsets"]) == {"t": {"0": 5, "1": 7, "2": 3}}
