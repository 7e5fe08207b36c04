"""Row positions, splits and file cuts, checked against plain loops."""

import random
import time
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferryline import SpecError
from ferryline.operators import chain, ordinal, segment
from ferryline.sinks import topic as topic_sink


def cuts(costs, max_bytes, max_count):
    """Segment ids of one worker's elements, one element at a time."""
    ids, number, size, count = [], 0, 0, 0
    for cost in costs:
        ids.append(number)
        size, count = size + cost, count + 1
        if size >= max_bytes or count >= max_count:
            number, size, count = number + 1, 0, 0
    return ids


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.integers(2, 12), min_size=1, max_size=80),
    st.one_of(st.integers(1, 70), st.just(segment.NO_LIMIT)),
    st.one_of(st.integers(1, 15), st.just(segment.NO_LIMIT)),
    st.integers(1, 25),
)
def test_chunks_chain_to_the_sequential_cuts(costs, max_bytes, max_count, chunk):
    number = size = count = 0
    got = []
    for at in range(0, len(costs), chunk):
        part = np.array(costs[at : at + chunk], np.int64)
        ids, *_ = segment.cut_batch(part, number, size, count, max_bytes, max_count)
        got += ids.tolist()
        steps = SimpleNamespace(**segment.chunk_steps(part, max_bytes, max_count))
        closed, size, count = segment.step_through(steps, size, count, max_bytes, max_count)
        number += closed
    assert got == cuts(costs, max_bytes, max_count)


def test_steps_stay_few_when_cuts_fall_together():
    rng = np.random.default_rng(1)
    steps = segment.chunk_steps(rng.integers(50, 5000, 50_000), 200_000, segment.NO_LIMIT)
    assert len(steps["closed"]) < 30


@pytest.mark.parametrize("limit", ["20 kb", "15 mb", "150 mb"])
@pytest.mark.parametrize("count", [None, 300_000])
def test_a_chunk_hands_over_little_and_a_tree_of_chunks_not_more(limit, count):
    """A function is short wherever files end in the stretch, and never has more steps than a file has elements."""
    rng, limits = np.random.default_rng(2), chain.Limits(*segment._limits(limit, count))
    parts = [rng.integers(60, 600, 250_000) for _ in range(chain.FAN)]
    functions = [segment.steps_of(cost, i, *vars(limits).values()) for i, cost in enumerate(parts)]
    whole = functions[0]
    for one in functions[1:]:
        whole = whole.then(one, limits)
    longest_file = min(limits.max_count, limits.max_bytes // 300)
    assert all(len(one.packed()) < 6 * min(len(one.closed), 1.2 * longest_file) + 2_000 for one in functions)
    assert len(whole.packed()) < 6 * 1.2 * longest_file + 2_000
    for open_cost, open_count in ((0, 0), (70, 1), (limits.max_bytes // 2, 77), (limits.max_bytes - 1, 10)):
        state, closed = (open_cost, open_count), 0
        for cost in parts:
            _, closed, *state = segment.cut_batch(cost, closed, *state, limits.max_bytes, limits.max_count)
        got = whole.outcomes(np.array([open_cost]), np.array([open_count]), limits)
        assert [int(v[0]) for v in got[:3]] == [closed, *state]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.integers(2, 12), min_size=1, max_size=80),
    st.one_of(st.integers(1, 90), st.just(segment.NO_LIMIT)),
    st.one_of(st.integers(1, 25), st.just(segment.NO_LIMIT)),
    st.integers(1, 9),
    st.integers(0, 80),
)
def test_functions_compose(costs, max_bytes, max_count, chunk, before):
    limits = chain.Limits(max_bytes, max_count)
    functions = [segment.steps_of(np.array(costs[at : at + chunk], np.int64), at // chunk, max_bytes, max_count) for at in range(0, len(costs), chunk)]
    while len(functions) > 1:
        functions = [a.then(b[0], limits) if b else a for a, *b in (functions[i : i + 2] for i in range(0, len(functions), 2))]
    whole = chain.Steps.unpacked(functions[0].packed())
    open_count = min(-(-before // 7), max_count - 1)
    open_cost = min(before, max_bytes - 1) if open_count else 0
    open_count = open_count if open_cost else 0
    ids, closed, *left = segment.cut_batch(np.array(costs, np.int64), 0, open_cost, open_count, max_bytes, max_count)
    *got, unit = (int(v[0]) for v in whole.outcomes(np.array([open_cost]), np.array([open_count]), limits))
    assert got == [closed, *left]
    if left[1] and (closed or not open_count):
        assert unit == (len(costs) - left[1]) // chunk
    elif left[1]:
        assert unit == -1


@pytest.fixture(scope="module")
def elements(spark):
    """Three workers; one has most rows. Order values are spread, costs vary."""
    rng = random.Random(7)
    rows = [(0 if i % 3 else i % 7, i * 13 % 4001, rng.choice([5, 5, 5, 90, 400])) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "worker int, seq int, cost bigint").repartition(6)


def by_worker(rows):
    groups = defaultdict(list)
    for worker, seq, cost in sorted(rows):
        groups[worker].append((seq, cost))
    return groups


LIMITS = [
    (1000, None, 7), (1000, None, 100_000), (1000, 9, 1), (1000, 9, 64), (None, 9, 64), (10**9, None, 7), (1, None, 64),
]


@pytest.mark.parametrize("max_bytes, max_count, chunk_rows", LIMITS)
def test_assign_segments(elements, max_bytes, max_count, chunk_rows):
    rows, df = elements
    got = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), max_bytes, max_count, chunk_rows=chunk_rows)
    assert got.columns == ["worker", "seq", "cost", "segment_id"]
    found = {(r.worker, r.seq): r.segment_id for r in got.collect()}
    want = {}
    for worker, items in by_worker(rows).items():
        ids = cuts([c for _, c in items], max_bytes or segment.NO_LIMIT, max_count or segment.NO_LIMIT)
        want.update({(worker, seq): i for (seq, _), i in zip(items, ids)})
    assert found == want


@pytest.mark.parametrize("max_bytes, max_count, chunk_rows", [LIMITS[0], LIMITS[3], (20_000, None, 7)])
def test_assign_segments_over_many_levels(elements, monkeypatch, max_bytes, max_count, chunk_rows):
    monkeypatch.setattr(chain, "FAN", 3)
    test_assign_segments(elements, max_bytes, max_count, chunk_rows)


@pytest.mark.parametrize("max_bytes, max_count, chunk_rows", [*LIMITS[:2], *LIMITS[3:], (None, None, 64)])
def test_units_hold_whole_files(elements, max_bytes, max_count, chunk_rows):
    """Rows stream out clustered by unit; cutting each unit afresh gives every file, once and whole."""
    rows, df = elements
    placed = segment.place_units(df, "worker", ["seq"], F.col("cost"), max_bytes, max_count, chunk_rows)
    assert placed.columns == ["_worker", "_unit", "_segment", "_size", "worker", "seq", "cost"]
    size, count = max_bytes or segment.NO_LIMIT, max_count or segment.NO_LIMIT
    got, tasks, last = {}, defaultdict(set), None
    for r in placed.withColumn("task", F.spark_partition_id()).collect():
        if (r._worker, r._unit) != last:
            last, state = (r._worker, r._unit), (r._segment, 0, 0)
            assert not tasks[last], "a unit comes in one stretch"
        tasks[last].add(r.task)
        ids, *rest = segment.cut_batch(np.array([r._size]), *state, size, count)
        state = tuple(rest)
        got[r.worker, r.seq] = int(ids[0])
    assert all(len(t) == 1 for t in tasks.values())
    want = {}
    for worker, items in by_worker(rows).items():
        ids = cuts([c for _, c in items], size, count)
        want.update({(worker, seq): i for (seq, _), i in zip(items, ids)})
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(2, 9), min_size=1, max_size=60), st.integers(1, 70), st.integers(1, 15))
def test_fixed_length_is_only_claimed_when_it_holds(costs, max_bytes, max_count):
    length = segment.fixed_length(min(costs), max(costs), max_bytes, max_count)
    if length is not None:
        assert cuts(costs, max_bytes, max_count) == [i // length for i in range(len(costs))]


def test_fixed_length_cases():
    none = segment.NO_LIMIT
    assert segment.fixed_length(7, 7, 20, none) == 3 == segment.fixed_length(7, 7, 21, none)
    assert segment.fixed_length(2, 9, 1000, 50) == 50 and segment.fixed_length(2, 9, 100, 50) is None
    assert segment.fixed_length(None, None, 10, 10) is None and segment.fixed_length(0, 5, 10, none) is None


def test_equal_elements_need_no_chunks(spark, monkeypatch):
    monkeypatch.setattr(segment, "chunk_steps", None)
    df = spark.createDataFrame([(i % 2, i, 7) for i in range(40)], "worker int, seq int, cost bigint")
    got = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), 20).orderBy("worker", "seq").collect()
    assert [r.segment_id for r in got] == [i // 3 for i in range(20)] * 2


def test_assign_segments_by_shuffle_join(elements, monkeypatch):
    """The same result when the chunk table is too long to broadcast."""
    rows, df = elements
    want = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), 1000, 9).collect()
    monkeypatch.setattr(segment, "checked_broadcast", lambda frame: frame)
    monkeypatch.setattr(ordinal, "checked_broadcast", lambda frame: frame)
    got = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), 1000, 9, chunk_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    units = segment.place_units(df, "worker", ["seq"], F.col("cost"), 1000, 9, 50)
    first = units.groupBy("_worker", "_unit").agg(F.min_by("_segment", "seq").alias("s"), F.min("seq").alias("seq"))
    assert {(r._worker, r.seq): r.s for r in first.collect()}.items() <= {(r.worker, r.seq): r.segment_id for r in want}.items()


def test_no_limit_is_one_file(elements):
    _, df = elements
    got = segment.assign_segments(df, "worker", ["seq"])
    assert [r[0] for r in got.select("segment_id").distinct().collect()] == [0]


def test_empty_input_has_no_segments(spark):
    empty = spark.createDataFrame([], "worker int, seq int, cost bigint")
    assert segment.assign_segments(empty, "worker", ["seq"], F.col("cost"), 10, 10).count() == 0


def test_size_text_and_bad_limits(elements):
    _, df = elements
    a = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), "1 kb").agg(F.max("segment_id")).head()
    b = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), 1024).agg(F.max("segment_id")).head()
    assert a == b
    for limits in [{"max_bytes": 0}, {"max_count": 0}, {"max_bytes": 5, "max_count": 0}]:
        with pytest.raises(SpecError):
            segment.assign_segments(df, "worker", ["seq"], F.col("cost"), **limits)
    with pytest.raises(SpecError):
        segment.assign_segments(df, "worker", ["seq"], None, 10)


def test_two_halves_fill_a_file(spark):
    """A limit of 100 with elements of 50: the second fills the file."""
    df = spark.createDataFrame([(1, i, 50) for i in range(5)], "worker int, seq int, cost bigint")
    got = segment.assign_segments(df, "worker", ["seq"], F.col("cost"), 100).orderBy("seq").collect()
    assert [r.segment_id for r in got] == [0, 0, 1, 1, 2]


# --- positions ---------------------------------------------------------------------------------------------


def test_ordinal_per_key_and_total(elements):
    rows, df = elements
    got = ordinal.with_ordinal(df, ["seq"], ["worker"], "at", "n").collect()
    for worker, items in by_worker(rows).items():
        mine = sorted((r.at, r.seq, r.n) for r in got if r.worker == worker)
        assert mine == [(i, seq, len(items)) for i, (seq, _) in enumerate(items)]


def test_intermediate_tables_are_dropped(spark, tmp_path, monkeypatch):
    from ferryline import session

    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    with session.intermediates_dropped(spark):
        assert session.materialise(spark.range(5), "numbers").count() == 5
        assert list(tmp_path.glob("ferryline/numbers-*"))
    assert not list(tmp_path.glob("ferryline/numbers-*"))


def test_numbering_writes_no_table(spark, tmp_path, monkeypatch):
    from ferryline import session

    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    assert ordinal.with_ordinal(spark.range(5), ["id"]).count() == 5
    assert not list(tmp_path.iterdir())


def test_ordinal_without_key_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 0)], "k string, o int")
    assert sorted((r.o, r.at) for r in ordinal.with_ordinal(df, ["o"], name="at").collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    got = sorted((r.o, r.at) for r in ordinal.with_ordinal(df, ["o"], ["k"], "at").collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_hot_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "ROWS_PER_BUCKET", 500)
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), ((F.col("id") * 7919) % 20_011).alias("o"))
    placed = ordinal._with_bucket(df, ["k", "o"], "bucket").groupBy("bucket").count()
    assert placed.count() >= 20 and placed.agg(F.max("count")).head()[0] < 2_000
    ranked = ordinal.with_ordinal(df, ["o"], ["k"], "at")
    hot = ranked.filter("k = -1").orderBy("o").collect()
    assert [r["at"] for r in hot] == list(range(18_000))
    assert ranked.filter("k >= 0").agg(F.max("at")).head()[0] == 0


@pytest.mark.parametrize("short", [True, False])
def test_planning_does_not_grow_with_the_steps_of_the_search(spark, monkeypatch, short):
    """Following the bucket back through every step would take a minute and more here, and all of a small driver's memory beyond."""
    monkeypatch.setattr(ordinal, "ROWS_PER_BUCKET", 50)
    if not short:
        monkeypatch.setattr(ordinal, "checked_broadcast", lambda frame: frame)
    rows = [(i % 4, i * 7919 % 5003, i) if i % 50 else (None, None, i) for i in range(4_000)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    ranked = ordinal.with_ordinal(df, ["a", "b"], ["k"], "at")
    started = time.monotonic()
    ranked._jdf.queryExecution().optimizedPlan()
    assert time.monotonic() - started < 15
    got = {r.b: r.at for r in ranked.collect()}
    for key in (None, 0, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(len(own)))


def parts(n, pieces):
    """Contiguous chunks with ends at ceil(p * n / pieces)."""
    ends = [-(-p * n // pieces) for p in range(pieces + 1)]
    return [p for p in range(pieces) for _ in range(ends[p], ends[p + 1])]


@pytest.mark.parametrize("n, pieces", [(10, 3), (3, 10), (7, 7), (100, 8), (1, 1)])
def test_even_split(spark, n, pieces):
    got = ordinal.even_split(spark.range(n), ["id"], pieces).orderBy("id").collect()
    assert [r.part for r in got] == parts(n, pieces)


def test_first_n_and_parallelism(spark):
    assert [r.id for r in ordinal.first_n(spark.range(10), ["id"], 3).collect()] == [0, 1, 2]
    assert ordinal.first_n(spark.range(2), ["id"], 5).count() == 2
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    four = spark.range(0, 100, 1, 4)
    assert [tasks(ordinal.limit_workers(four, n)) for n in (1, 3, 9)] == [1, 3, 4]


# --- names -------------------------------------------------------------------------------------------------


def test_names(spark):
    row = spark.range(1).select(
        segment.file_path("j%b", F.lit(1), F.lit(0), "parquet").alias("path"),
        segment.object_key(F.lit("a/b/j-1-0.json")).alias("key"),
    ).head()
    assert row.path == "j%b/sink/1/j%b-1-0.parquet" and row.key == "j-1-0"


# --- topic batches -----------------------------------------------------------------------------------------


def test_round_robin_in_order(spark):
    rows = spark.range(45).select((F.col("id") % 2).alias("worker"), "id", F.lit(b"v").alias("value"), F.col("id").alias("ts_ms"))
    got = topic_sink.assign_partitions_ordered(rows, 5, [7, 8, 9], "worker", ["id"]).collect()
    for r in got:
        assert r.partition == [7, 8, 9][(r.id // 2) // 5 % 3]
    sent = topic_sink.to_records(topic_sink.assign_partitions(rows, 5, [0]), "t").collect()
    assert {r.partition for r in sent} == {0} and all(r.key is None for r in sent)
    assert {(r.headers or [None])[0] and bytes(r.headers[0]["value"]) for r in sent if r.headers} == {str(i).encode() for i in range(1, 45)}


def test_round_robin_within_tasks(spark):
    rows = spark.range(0, 40, 1, 2).select(F.spark_partition_id().alias("task"), "id")
    got = topic_sink.assign_partitions(rows, 3, [0, 1]).collect()
    assert all(r.partition == (r.id % 20) // 3 % 2 for r in got)


def test_round_robin_rules():
    for bad in (0, -1):
        with pytest.raises(SpecError):
            topic_sink.producer_options(bad)
    assert topic_sink.producer_options(400) == {"kafka.batch.size": "400", "kafka.linger.ms": "1000"}
