"""File sinks and file scans, in temporary folders of the test run."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline import EmptyRangeError, SpecError
from ferryline.sinks import files as sink
from ferryline.sources import files as source
from ferryline.sources.files import FileRange
from ferryline.streaming import available_now


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.startswith("."))


@pytest.fixture
def rows(spark):
    return spark.range(0, 10, 1, 3).select((F.col("id") % 2).alias("worker"), F.col("id").alias("seq"), F.to_json(F.struct("id")).alias("value"))


def test_array_file_bytes_and_names(rows, tmp_path):
    sink.write_json_arrays(rows, str(tmp_path), "job", max_count=2)
    assert tree(tmp_path) == sorted(f"job/sink/{w}/job-{w}-{s}.json" for w in (0, 1) for s in (0, 1, 2))
    assert (tmp_path / "job/sink/0/job-0-0.json").read_bytes() == b'[\n{"id":0},\n{"id":2}\n]'
    assert (tmp_path / "job/sink/1/job-1-2.json").read_bytes() == b'[\n{"id":9}\n]'


def test_existing_file_is_an_error_and_leaves_nothing(rows, tmp_path):
    sink.write_json_arrays(rows, str(tmp_path), "job", max_count=2)
    before = tree(tmp_path)
    with pytest.raises(PySparkException, match="exists already"):
        sink.write_json_arrays(rows, str(tmp_path), "job", max_count=4)
    assert tree(tmp_path) == before


def test_failing_task_leaves_no_file(spark, rows, tmp_path):
    """Tasks still running at the failure may leave attempt files, under a name readers pass over."""
    bad = rows.withColumn("value", F.when(F.col("seq") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        sink.write_as_they_come(bad.select("value"), str(tmp_path), "job")
    assert [f for f in tree(tmp_path) if not f.startswith("_attempts-")] == []
    (tmp_path / "_attempts-x").mkdir()
    (tmp_path / "_attempts-x" / "0-0").write_text("[\n1")
    (tmp_path / "ok.json").write_text("[1]")
    assert names(source.list_files(spark, str(tmp_path))) == ["ok.json"]


def test_no_rows_no_files(rows, tmp_path):
    sink.write_json_arrays(rows.filter("seq < 0"), str(tmp_path), "job", max_bytes="1 kb")
    sink.write_as_they_come(rows.filter("seq < 0").select("value"), str(tmp_path), "job")
    assert tree(tmp_path) == []


def test_layouts(rows, tmp_path):
    sink.write_json_arrays(rows, str(tmp_path / "f"), "job", layout="flat")
    sink.write_json_arrays(rows, str(tmp_path / "o"), "job", layout="object")
    assert tree(tmp_path / "f") == ["job-0-0.json", "job-1-0.json"]
    assert tree(tmp_path / "o") == ["job-0-0", "job-1-0"]


def test_size_limit_counts_the_frame(spark, tmp_path):
    """Two elements of 8 bytes make 2 + 8 + 2 + 8 = 20 bytes before the closing bracket."""
    values = spark.createDataFrame([(0, i, "12345678") for i in range(5)], "worker int, seq int, value string")
    sink.write_json_arrays(values, str(tmp_path), "job", max_bytes=20, layout="flat")
    assert [len(json.loads((tmp_path / f"job-0-{i}.json").read_text())) for i in range(3)] == [2, 2, 1]


def test_each_task_cuts_its_own_files(spark, tmp_path):
    texts = spark.range(0, 20, 1, 2).select(F.to_json(F.struct("id")).alias("value"))
    sink.write_as_they_come(texts, str(tmp_path), "job", max_count=4)
    assert tree(tmp_path) == sorted(f"job-{w}-{s}.json" for w in (0, 1) for s in (0, 1, 2))
    read = source.read_json_arrays(spark, str(tmp_path)).select(F.get_json_object("value", "$.id").cast("int"))
    assert sorted(r[0] for r in read.collect()) == list(range(20))
    assert json.loads((tmp_path / "job-1-2.json").read_text()) == [{"id": 18}, {"id": 19}]


def test_parquet_segments(spark, rows, tmp_path):
    sink.write_parquet_segments(rows.withColumn("n", F.col("seq") * 2), str(tmp_path), "job", max_count=3, layout="flat")
    assert tree(tmp_path) == sorted(f"job-{w}-{s}.parquet" for w in (0, 1) for s in (0, 1))
    back = spark.read.parquet(str(tmp_path))
    assert set(back.columns) == {"value", "n"} and back.count() == 10
    sized = rows.select(F.lit(30).cast("bigint").alias("_size"), "value")
    sink.write_as_they_come(sized, str(tmp_path / "s"), "job", "parquet", max_bytes=60)
    assert spark.read.parquet(str(tmp_path / "s")).columns == ["value"]
    assert len(tree(tmp_path / "s")) == 6


def test_plain_parquet(spark, tmp_path):
    sink.write_parquet(spark.range(0, 10, 1, 2), str(tmp_path / "p"), max_count=3)
    assert len([f for f in tree(tmp_path / "p") if f.endswith(".parquet")]) == 4


def test_bad_writer_options(rows, tmp_path):
    for call in (
        lambda: sink.write_json_arrays(rows, str(tmp_path), "j", layout="odd"),
        lambda: sink.write_as_they_come(rows, str(tmp_path), "j"),
        lambda: sink.write_as_they_come(rows.select("value"), str(tmp_path), "j", "csv"),
    ):
        with pytest.raises(PySparkException):
            call()


def test_object_bytes(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"\x00\x01"), ("b.bin", b"\xff")], "key string, content binary")
    sink.write_objects(rows, str(tmp_path))
    got = {r.key.rsplit("/", 1)[1]: bytes(r.content) for r in source.read_bytes(spark, str(tmp_path)).collect()}
    assert got == {"x.bin": b"\x00\x01", "b.bin": b"\xff"}


# --- reading -----------------------------------------------------------------------------------------------


def test_array_reader_takes_any_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [ {"a" : 1, "b": [1, 2]},\n\n {"a":\n2} ]\n')
    (tmp_path / "b.json").write_text("[\n\n]")
    got = sorted(r.value for r in source.read_json_arrays(spark, str(tmp_path)).collect())
    assert got == ['{"a":1,"b":[1,2]}', '{"a":2}']


def test_typed_array_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a":1,"c":0},\n{"a":2}]')
    got = source.read_json_array_records(spark, str(tmp_path), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(map(tuple, got.collect())) == [(1,), (2,)]


@pytest.mark.parametrize("text", ['{"a":1}', "nonsense", '"[1]"'])
def test_not_an_array(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(PySparkException, match="JSON array"):
        source.read_json_arrays(spark, str(tmp_path)).collect()


def test_line_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a":1},\n{"a":2}\n]')
    (tmp_path / "b.json").write_text("[\n\n]")
    assert sorted(r.value for r in source.read_json_array_lines(spark, str(tmp_path)).collect()) == ['{"a":1}', '{"a":2}']
    (tmp_path / "c.json").write_text('[\n{"a":\n1}\n]')
    with pytest.raises(PySparkException, match="not an array element"):
        source.read_json_array_lines(spark, str(tmp_path)).collect()


@pytest.fixture
def folder(tmp_path):
    """Files around the range 1000..2000 s, some below, with two name prefixes."""
    for name, seconds in {
        "test-before.json": 999, "test-from.json": 1000, "test-mid.json": 1500, "test-to.json": 2000,
        "test-after.json": 2001, "other-mid.json": 1500, "sub/test-deep.json": 1500,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(f'[{{"f":"{name}"}}]')
        os.utime(path, (seconds, seconds))
    return tmp_path


def names(df):
    return sorted(r.name for r in df.collect())


def test_range_edges_are_inclusive(spark, folder):
    wanted = FileRange(("test-",), 1_000_000, 2_000_000)
    assert names(source.scan_tree(spark, str(folder), wanted)) == ["test-deep.json", "test-from.json", "test-mid.json", "test-to.json"]
    assert names(source.scan_tree(spark, str(folder), wanted, recursive=False)) == ["test-from.json", "test-mid.json", "test-to.json"]
    read = source.read_json_arrays(spark, str(folder), wanted)
    assert read.count() == 4


def test_files_out_of_range_are_not_opened(spark, folder):
    """The range works on the file list, so broken files outside it do no harm and are not counted as read."""
    for name in ("test-before.json", "other-mid.json"):
        at = os.stat(folder / name).st_mtime
        (folder / name).write_text("broken")
        os.utime(folder / name, (at, at))
    wanted = FileRange(("test-",), 1_000_000, 2_000_000)
    read = source.read_json_arrays(spark, str(folder), wanted)
    assert read.select(F.input_file_name()).distinct().count() == 4
    plan = read._jdf.queryExecution().executedPlan()
    read.collect()
    scans = plan.collectLeaves()
    metrics = scans.head().metrics()
    assert metrics.get("numFiles").get().value() in (0, 4)


def test_prefixes(spark, folder):
    assert names(source.scan_tree(spark, str(folder), FileRange(("other-", "test-m")), False)) == ["other-mid.json", "test-mid.json"]
    assert len(names(source.scan_tree(spark, str(folder), FileRange()))) == 7
    assert len(names(source.scan_tree(spark, str(folder), FileRange(modified_to=1_000_000)))) == 2
    assert len(names(source.scan_tree(spark, str(folder), FileRange(modified_from=2_000_001)))) == 1


def test_a_file_skips_the_predicates(spark, folder):
    wanted = FileRange(("nope",), 0, 1)
    assert names(source.scan_tree(spark, str(folder / "test-mid.json"), wanted)) == ["test-mid.json"]


def test_nothing_found(spark, folder):
    with pytest.raises(EmptyRangeError):
        source.scan_tree(spark, str(folder), FileRange(("zzz",)))
    with pytest.raises(SpecError, match="does not exist"):
        source.scan_tree(spark, str(folder / "zzz"), FileRange())


def test_objects_per_prefix(spark, folder):
    read = lambda path, times: source.read_json_arrays(spark, path, times)
    twice = FileRange(("test-", "test-m", "none"), 1_000_000, 2_000_000)
    assert names(source.list_objects(spark, str(folder), twice)) == ["test-from.json", "test-mid.json", "test-mid.json", "test-to.json"]
    assert source.read_objects(str(folder), twice, read).count() == 4
    assert source.read_objects(str(folder), FileRange(("sub/te",)), read).count() == 1
    assert source.read_objects(str(folder), FileRange(), read).count() == 7
    for nothing in (FileRange(("none",)), FileRange(("test-",), 1, 2)):
        with pytest.raises(EmptyRangeError):
            source.list_objects(spark, str(folder), nothing)


def test_glob_characters_in_a_prefix(spark, tmp_path):
    (tmp_path / "a[1]x.json").write_text("[1]")
    (tmp_path / "a1x.json").write_text("[2]")
    assert names(source.list_objects(spark, str(tmp_path), FileRange(("a[1]",)))) == ["a[1]x.json"]


def test_listing_table(spark):
    listing = spark.createDataFrame([("p/a", 5), ("p/ab", 6), ("q", 7), ("p/a", 99)], "key string, modified_ms bigint")
    both = FileRange(("p/a", "p/ab"), 5, 7)
    assert sorted(r.key for r in source.select_objects(listing, both).collect()) == ["p/a", "p/ab", "p/ab"]
    assert sorted(r.key for r in source.select_objects(listing, both, dedupe=True).collect()) == ["p/a", "p/ab"]
    assert source.select_objects(listing, FileRange()).count() == 4
    plan = source.select_objects(listing, both)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_messages_are_pruned(spark, tmp_path):
    spark.range(5).select("id", (F.col("id") * 2).alias("b")).write.parquet(str(tmp_path / "m"))
    read = source.read_messages(spark, str(tmp_path / "m")).select("b")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in plan


# --- streams -----------------------------------------------------------------------------------------------


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    def feed(name, start):
        spark.range(start, start + 50).select(F.to_json(F.struct("id")).alias("value")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    feed("a", 0)
    stream = spark.readStream.schema("value string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for expected, name in ((50, None), (50, None), (100, "b")):
        if name:
            feed(name, 50)
        available_now.drain_to_json_arrays(stream, str(tmp_path / "out"), "job", str(tmp_path / "check"), max_count=20)
        available_now.drain_to_parquet(stream, str(tmp_path / "pq"), str(tmp_path / "check2"))
        assert source.read_json_array_lines(spark, str(tmp_path / "out")).distinct().count() == expected
        assert spark.read.parquet(str(tmp_path / "pq")).count() == expected


def test_repeated_batch_replaces_its_files(spark, tmp_path):
    texts = spark.range(0, 9, 1, 1).select(F.col("id").cast("string").alias("value"))
    for pieces in (3, 1):
        sink.write_as_they_come(texts.repartition(pieces), str(tmp_path), "job.0", max_count=4, replace=True)
        sink.write_as_they_come(texts, str(tmp_path), "job.00", max_count=9, replace=True)
    assert tree(tmp_path) == ["job.0-0-0.json", "job.0-0-1.json", "job.0-0-2.json", "job.00-0-0.json"]


@pytest.mark.parametrize("text", ["[1,2][3,4]", "[1,2] trash", "[1] [2]", "[1"])
def test_text_behind_an_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(PySparkException, match="JSON array"):
        source.read_json_arrays(spark, str(tmp_path)).collect()
    with pytest.raises(PySparkException, match="not an array element"):
        source.read_json_array_lines(spark, str(tmp_path)).filter("value <> '[1]'").collect()


def test_elements_with_line_breaks_come_back_whole(spark, tmp_path):
    values = ['[\n 1,\n 2\n]', '{"a":\r\n{"b": "x\\ny"}}', "[[], [1]]", '"]"']
    rows = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)
    sink.write_as_they_come(rows, str(tmp_path / "out"), "job")
    for read in (source.read_json_array_lines, source.read_json_arrays):
        got = [json.loads(r.value) if r.value[:1] in '[{"' else r.value for r in read(spark, str(tmp_path / "out")).collect()]
        assert [json.loads(v) for v in values][:3] == got[:3] and len(got) == 4


def test_a_null_element_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("1",), (None,)], "value string")
    with pytest.raises(PySparkException, match="null value"):
        sink.write_as_they_come(rows, str(tmp_path / "out"), "job")


def test_folders_named_like_partitions_are_left_out_unless_recursive(spark, tmp_path):
    for place in ("top.json", "dt=1/in.json", "plain/in.json"):
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text(f'["{place}"]')
    def names(recursive):
        listed = source.scan_tree(spark, str(tmp_path), FileRange(), recursive)
        read = source.read_json_arrays(spark, str(tmp_path), FileRange(), recursive)
        assert sorted(r.key.split(str(tmp_path) + "/")[1] for r in listed.collect()) == sorted(r.value for r in read.collect())
        return sorted(r.value for r in read.collect())

    assert names(False) == ["top.json"]
    assert names(True) == ["dt=1/in.json", "plain/in.json", "top.json"]


def test_an_object_that_exists_is_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("k", bytearray(b"new")), ("other", bytearray(b"x"))], "key string, content binary")
    (tmp_path / "k").write_bytes(b"old")
    with pytest.raises(PySparkException, match="exists"):
        sink.write_objects(rows, str(tmp_path))
    assert (tmp_path / "k").read_bytes() == b"old" and os.listdir(tmp_path) == ["k"]


def test_listing_of_every_name_and_size(spark, tmp_path):
    for place in ("a.json", "_h.json", ".x/_y/deep.json", "dt=1/_in.json", "sp ace,{1}.json", "_attempts-1/0-0"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(f'["{place}"]')
    (tmp_path / "z.json").touch()
    os.utime(tmp_path / "a.json", (5, 5))

    def listed(wanted=FileRange(), recursive=True, path=tmp_path):
        return {r.key.split(f"{tmp_path}/")[1]: r for r in source.scan_tree(spark, str(path), wanted, recursive, every=True).collect()}

    top = {"a.json", "_h.json", "sp ace,{1}.json", "z.json"}
    assert set(listed(recursive=False)) == top
    assert set(listed()) == top | {".x/_y/deep.json", "dt=1/_in.json"}
    assert (listed()["z.json"].size, listed()["a.json"].modified_ms, listed()["_h.json"].name) == (0, 5000, "_h.json")
    assert set(listed(FileRange(("_",)))) == {"_h.json", "dt=1/_in.json"}
    assert set(listed(FileRange(modified_to=5000))) == {"a.json"}
    assert set(listed(path=tmp_path / "_h.json")) == {"_h.json"}
    assert set(listed(path=f"file:{tmp_path}/")) == set(listed())
    with pytest.raises(SpecError):
        listed(path=tmp_path / "gone")
    with pytest.raises(EmptyRangeError):
        listed(FileRange(("nothing",)))
    objects = source.list_objects(spark, str(tmp_path), FileRange((".x/", "_", "_h")), every=True)
    assert sorted(r.name for r in objects.collect()) == ["_h.json", "_h.json", "deep.json"]


def test_listed_files_are_read_whatever_their_names(spark, tmp_path, monkeypatch):
    from ferryline.sources import listing

    monkeypatch.setattr(listing, "BYTES_A_TASK", 10)
    for name in ("a.json", "_h.json", ".d.json"):
        (tmp_path / name).write_text(f'\n[ "{name}", {{"é": [1]}} ]')
    found = source.scan_tree(spark, str(tmp_path), FileRange(), every=True)
    assert sorted(r.value for r in source.read_listed_arrays(found).collect()) == sorted(["a.json", "_h.json", ".d.json"] + ['{"é":[1]}'] * 3)
    (tmp_path / "z.json").touch()
    found = source.scan_tree(spark, str(tmp_path), FileRange(), every=True)
    assert [bytes(r.content) for r in source.read_listed(found).filter("key like '%z.json'").collect()] == [b""]
    with pytest.raises(PySparkException, match="does not hold one JSON array"):
        source.read_listed_arrays(found).collect()


def test_objects_listed_once_keep_rows_that_share_a_key(spark):
    listing = spark.createDataFrame([("p/ab", 5), ("p/ab", 6), ("p/ab", 6), ("p/a", 9), ("q", 6)], "key string, modified_ms bigint")
    once = source.select_objects(listing, FileRange(("p/a", "p/ab"), 5, 7), dedupe=True)
    assert sorted(map(tuple, once.collect())) == [("p/ab", 5), ("p/ab", 6), ("p/ab", 6)]
