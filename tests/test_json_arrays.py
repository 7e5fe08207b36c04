"""JSON array files of any layout, read in splits."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferryline import SpecError
from ferryline.sources import files as source
from ferryline.sources import json_arrays

LAYOUTS = [
    lambda v: json.dumps(v),
    lambda v: json.dumps(v, indent=3),
    lambda v: "\n [\n" + ",\n".join(json.dumps(x) for x in v) + "\n]\n\n",
    lambda v: "[" + " ,\t".join(json.dumps(x, separators=(" , ", " : ")) for x in v) + "]",
]


def made(seed, count):
    draw = random.Random(seed)

    def value(deep):
        kind = draw.randrange(8 if deep else 5)
        if kind == 0:
            return "".join(draw.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "日", " ", "\n", "x", "\\\\", '\\"']) for _ in range(draw.randrange(9)))
        if kind < 5:
            return [draw.randrange(-99, 99), True, None, draw.random()][kind - 1]
        if kind == 5:
            return [value(False) for _ in range(draw.randrange(5))]
        return {f"k{i},": value(draw.random() < 0.4) for i in range(draw.randrange(4))}

    return [{"id": i, "v": value(True)} for i in range(count)]


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of some hundred bytes, and no file parsed as a whole."""
    monkeypatch.setattr(source, "WHOLE_FILE_BYTES", 0)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    for key, value in kept.items():
        spark.conf.set(key, value)


def read(spark, folder):
    return sorted((json.loads(r.value) for r in source.read_json_arrays(spark, str(folder)).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_any_layout_in_small_splits(spark, tmp_path, small_splits, seed):
    want = []
    for i, layout in enumerate(LAYOUTS):
        values = made(seed * 10 + i, 60)
        want += values
        (tmp_path / f"{i}.json").write_text(layout(values))
    assert read(spark, tmp_path) == sorted(want, key=str)


def test_an_element_longer_than_many_splits(spark, tmp_path, small_splits):
    values = [1, {"long": ["a, b]" * 900, 2], "more": "," * 2000}, [[1, 2]], "x" * 3000 + "end", []]
    (tmp_path / "a.json").write_text(json.dumps(values))
    (tmp_path / "b.json").write_text(json.dumps(values[::-1], indent=1))
    found = [r.value for r in source.read_json_arrays(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([json.dumps(v, separators=(",", ":")) if not isinstance(v, str) else v for v in values] * 2)


def test_files_in_turns_of_their_own(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(json_arrays, "MAX_BROADCAST_ROWS", 4)
    want = []
    for i in range(6):
        values = made(i, 30)
        want += values
        (tmp_path / f"{i}.json").write_text(json.dumps(values, indent=1))
    assert read(spark, tmp_path) == sorted(want, key=str)


def test_an_array_within_the_array_is_one_element(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text("[\n[\n1,\n2\n]\n]")
    assert [r.value for r in source.read_json_arrays(spark, str(tmp_path)).collect()] == ["[1,2]"]
    with pytest.raises(PySparkException, match="not an array element"):
        source.read_json_array_lines(spark, str(tmp_path)).collect()


WRONG = [
    "[1,2][3,4]", "[1,2],", "[1,2],\n", "[1,2] trash", "[1,2", "[1,,2]", "[1,]", "[,1]", '{"a":1,"b":2}', "1,2", '"[1]"', "[1,2}", "[1,2]]", "[1,\"2]",
    "[\n1\n]\n[\n2\n]\ntrue", "[{]}]", "[1,2 3]", "  ", "[" + "1," * 700 + "1] [2]", "[" + "1," * 700, "[" + "1," * 700 + '"1]', "[" + "1," * 400 + "1]," + "1," * 400 + "1]",
]


@pytest.mark.parametrize("text", WRONG)
def test_text_that_is_no_array_is_an_error(spark, tmp_path, small_splits, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises((PySparkException, SpecError), match="file does not hold one JSON array"):
        source.read_json_arrays(spark, str(tmp_path)).collect()
    with pytest.raises((PySparkException, SpecError), match="not an array element"):
        source.read_json_array_lines(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("text", ["[]", " [ \n ] ", "[\n\n]"])
def test_empty_arrays(spark, tmp_path, small_splits, text):
    (tmp_path / "a.json").write_text(text)
    assert source.read_json_arrays(spark, str(tmp_path)).count() == 0
    assert source.read_json_array_lines(spark, str(tmp_path)).count() == 0


def test_lines_come_back_as_they_are(spark, tmp_path, small_splits):
    lines = [json.dumps(v) for v in made(5, 80)]
    (tmp_path / "a.json").write_text("[\n" + ",\n".join(lines) + "\n]")
    assert sorted(r.value for r in source.read_json_array_lines(spark, str(tmp_path)).collect()) == sorted(lines)


def test_splits_are_taken_and_small_files_are_not_read_twice(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(list(range(100))))
    large = json.dumps([{"id": i, "text": "x" * 1000} for i in range(12_000)], indent=2)
    (tmp_path / "b.json").write_text(large)
    assert len(large) > source.WHOLE_FILE_BYTES
    rows = source.read_json_arrays(spark, str(tmp_path))
    assert rows.count() == 12_100
    ids = rows.select(F.get_json_object("value", "$.id").cast("long").alias("id")).agg(F.sum("id"), F.count("id")).head()
    assert tuple(ids) == (sum(range(12_000)), 12_000)
