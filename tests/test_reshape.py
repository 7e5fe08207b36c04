"""Paths, flat specs, feature lines, protobuf and converters."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferryline import SpecError
from ferryline.functions.paths import parse_path, string_value, struct_path, variant_path
from ferryline.functions.scalars import default_registry
from ferryline.operators import bundled_protos, bundled_specs, protobuf
from ferryline.operators.convert import Conversion, ConverterRegistry, NamedConverter, by_column, convert
from ferryline.operators.feature_line import FeatureConfig, json_line, struct_line
from ferryline.operators.flatten import FlatSpec, FlatSpecRegistry, flat_json, flatten, struct_columns
from ferryline.types import DataType

SENSOR_JSON = {
    "name": "Sensor Alfa", "temperature": 23.0, "humidity": 53, "door": "OPEN",
    "location": {"x": 231, "y": -33}, "event": {"name": "Temperature Changed", "value": 5443},
}


@pytest.fixture(scope="module")
def sensor():
    return bundled_protos.bundled().get("Sensor")


@pytest.fixture(scope="module")
def sensors(spark, sensor):
    """The constant sensor, one with zeros only, one with an empty sub-message, and no message."""
    texts = [json.dumps(SENSOR_JSON), "{}", '{"location": {}, "humidity": 0, "door": "CLOSED"}', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, json string")
    rows = rows.withColumn("value", protobuf.json_to_bytes(F.col("json"), sensor))
    return rows.withColumn("m", protobuf.decode(F.col("value"), sensor)).orderBy("id")


# --- paths -------------------------------------------------------------------------------------------------


def test_parse_path():
    assert parse_path("a.[0].b") == ["a", 0, "b"] == parse_path("a[0].b")
    assert parse_path("a.[12]") == ["a", 12]
    with pytest.raises(SpecError):
        parse_path("")


NESTED = "named_struct('a', named_struct('b', 5, 's', cast(null as string)), 'l', array(named_struct('x', 1), named_struct('x', 2)))"


def test_struct_path(spark):
    row = spark.range(1).select(F.expr(NESTED).alias("m"))
    schema = row.schema["m"].dataType

    def get(path, **options):
        return row.select(struct_path(schema, path, F.col("m"), **options).alias("c")).head().c

    assert get("a.b") == 5
    assert get("a.s") == "" and get("a.s", unset="null") is None
    assert get("l.[1].x") == 2
    assert get("l.[9].x", unset="null") is None
    assert [r.x for r in get("l")] == [1, 2]
    with pytest.raises(PySparkException):
        get("l.[9].x", strict_index=True)
    for path in ("a", "a.none", "l.x", "a.b.c", "a.[0]"):
        with pytest.raises(SpecError):
            struct_path(schema, path, F.col("m"))


def test_variant_path(spark):
    text = json.dumps({"a": {"b": 7, "k-y": "t"}, "l": [{"x": 1}, 5], "n": None})
    row = spark.range(1).select(F.parse_json(F.lit(text)).alias("v"))

    def get(path, kind="string", **options):
        return row.select(variant_path(F.col("v"), path, kind, **options).alias("c")).head().c

    assert get("a.b", "bigint") == 7 and get("a.k-y") == "t"
    assert get("l.[0].x", "int") == 1 and get("l.[1]", "int") == 5
    assert get("l.[4]") is None and get("a.zz") is None and get("n.a") is None
    assert get("a.b.c.d") is None and get("a.b.c.d", "bigint", scalar_passthrough=True) == 7
    assert get("l.[1].deep", "int", scalar_passthrough=True) == 5
    assert get("a.zz.y", scalar_passthrough=True) is None


def test_string_value(spark):
    assert spark.range(1).select(string_value(F.lit(5))).head()[0] == "5"
    with pytest.raises(PySparkException):
        spark.range(1).select(string_value(F.lit(None).cast("int"))).collect()


# --- flat specs --------------------------------------------------------------------------------------------


def test_sensor_spec_on_the_constant(sensors):
    flat = flatten(sensors, bundled_specs.bundled().get("sensor_flatted"), "m", ["id"]).orderBy("id").collect()
    assert flat[0].asDict() == {
        "id": 0, "name_new": "Sensor Alfa", "humidity_new": 53, "door_state": "OPEN", "location_x": 231,
        "event_name": "Temperature Changed", "event_value": 5443,
    }
    assert (flat[1].name_new, flat[1].humidity_new, flat[1].location_x, flat[1].event_name) == ("", 0, 0, "")


def test_bundled_specs_round_trip_as_mappings():
    registry = bundled_specs.bundled()
    assert {n: len(registry.get(n).fields) for n in registry.names()} == {
        "sensor_flatted": 6, "video_ad_flatted": 32, "ad_feedback_flatted_default": 125,
    }
    for name in registry.names():
        spec = registry.get(name)
        assert FlatSpec.from_json(name, json.dumps(spec.to_mapping())) == spec


def test_spec_folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.json").write_text('{"a": {"name": "x.y", "transformation": null, "defaultValue": 1}}')
    registry = FlatSpecRegistry()
    registry.load_folder(tmp_path)
    assert registry.names() == ["one"] and registry.get("one").fields[0].path == "x.y"
    with pytest.raises(SpecError):
        registry.get("two")


def test_defaults(spark):
    row = spark.range(1).select(F.expr("named_struct('a', cast(null as int), 'l', array(named_struct('name', 'n', 'value', 2.0D)))").alias("m"))
    spec = FlatSpec.from_mapping(
        "d",
        {
            "plain": {"name": "a", "defaultValue": 9},
            "flag": {"name": "a", "transformation": {"function": "none"}, "defaultValue": 8},
            "found": {"name": "l", "transformation": {"function": "searchCoecsInArray", "selectors": "n=value"}, "defaultValue": 0.5},
            "lost": {"name": "l", "transformation": {"function": "searchCoecsInArray", "selectors": "z=value"}, "defaultValue": 0.5},
            "again": {"name": "a"},
        },
    )
    functions = default_registry()
    functions.add("none", lambda value: value)
    always = flatten(row, spec, "m", functions=functions).head()
    assert tuple(always) == (9, 8, 2.0, 0.5, 0)
    some = flatten(row, spec, "m", functions=functions, defaults="function_only", unset="null").head()
    assert tuple(some) == (None, 8, 2.0, 0.5, None)


def test_default_of_another_type(spark):
    row = spark.range(1).select(F.expr("named_struct('n', cast(null as bigint), 't', cast(null as string))").alias("m"))
    spec = FlatSpec.from_mapping("d", {"n": {"name": "n", "defaultValue": ""}, "t": {"name": "t", "defaultValue": 0}})
    assert tuple(flatten(row, spec, "m").head()) == (None, "0")


def test_json_spec(spark):
    rows = spark.createDataFrame([('{"u":{"ids":[1,2]},"p":{"c":[{"name":"a","value":1.5}]},"n":4}',), ("{}",)], "j string")
    spec = FlatSpec.from_mapping(
        "j",
        {
            "ids": {"name": "u.ids", "transformation": {"function": "arrayIdsFlatten"}, "defaultValue": ""},
            "coec": {"name": "p.c", "transformation": {"function": "searchCoecsInArray", "selectors": "a=value"}, "defaultValue": 0.0},
            "n": {"name": "n", "defaultValue": 0},
        },
    )
    flat = flatten(rows.select(F.parse_json("j").alias("v")), spec, "v")
    assert [tuple(r) for r in flat.collect()] == [("1,2", 1.5, 4), ("", 0.0, 0)]
    assert dict(flat.dtypes) == {"ids": "string", "coec": "double", "n": "bigint"}


def test_flat_json_keeps_nulls_and_numbers(spark):
    text = spark.range(1).select(flat_json([F.lit(2**60).alias("a"), F.lit(None).cast("int").alias("b")])).head()[0]
    assert text == '{"a":1152921504606846976,"b":null}'


def test_unknown_path_is_refused_before_running(sensor):
    spec = FlatSpec.from_mapping("x", {"a": {"name": "nope.x"}})
    with pytest.raises(SpecError):
        struct_columns(sensor.schema(), spec, F.col("m"))


# --- feature lines -----------------------------------------------------------------------------------------

LINE = {
    "type": "PROTO",
    "features": [
        {"featureInProto": "humidity", "featureName": "", "featureType": "PREDICT_VALUE"},
        {"featureInProto": "name", "featureName": "n", "namespace": "a", "featureType": "BINARY"},
        {"featureInProto": "location.x", "featureName": "x", "namespace": "a", "featureType": "NON_BINARY"},
        {"featureInProto": "location.y", "featureName": "y", "namespace": "b", "featureType": "NON_BINARY"},
        {"featureInProto": "door", "featureName": "d", "featureType": "AUTO_FILLED"},
        {
            "featureInProto": "temperature", "featureName": "t", "namespace": "b", "featureType": "NON_BINARY",
            "transformation": {"function": "sumFloat", "others": [{"featureInProto": "humidity"}]},
        },
        {"featureInProto": "event.value", "featureName": "v", "namespace": "a", "featureType": "NON_BINARY"},
    ],
}


def test_line(sensors, sensor):
    config = FeatureConfig.from_json(json.dumps(LINE))
    first = sensors.filter("id = 0")
    line = first.select(struct_line(sensor.schema(), config, F.col("m"))).head()[0]
    assert line == "53|a nSensor Alfa:1.0 x:231|b y:-33 dOPEN t:76.0|a v:5443"
    line = first.select(struct_line(sensor.schema(), config, F.col("m"), space_before_bar=True)).head()[0]
    assert line == "53 |a nSensor Alfa:1.0 x:231 |b y:-33 dOPEN t:76.0 |a v:5443"


def test_json_line_and_missing_value(spark):
    config = FeatureConfig.from_json(
        '{"type": "HASHMAP", "features": [{"featureInProto": "a.b", "featureName": "f", "namespace": "n", "featureType": "NON_BINARY"}]}'
    )
    rows = spark.createDataFrame([('{"a":{"b":1}}',), ("{}",)], "j string").select(F.parse_json("j").alias("v"))
    assert rows.filter("variant_get(v, '$.a') is not null").select(json_line(F.col("v"), config)).head()[0] == "|n f:1"
    with pytest.raises(PySparkException, match="has no value"):
        rows.select(json_line(F.col("v"), config)).collect()


@pytest.mark.parametrize("config", ['{"type": "LIST", "features": []}', '{"features": [{"featureInProto": "a", "featureType": "ODD"}]}'])
def test_bad_line_config(config):
    with pytest.raises(SpecError):
        FeatureConfig.from_json(config)


# --- protobuf ----------------------------------------------------------------------------------------------


def test_decode_and_presence(sensors):
    rows = sensors.collect()
    assert rows[0].m.asDict(recursive=True) == SENSOR_JSON
    assert rows[1].m.location is None and rows[1].m.door == "CLOSED" and rows[1].m.name == ""
    assert tuple(rows[2].m.location) == (0, 0)
    assert rows[3].m is None and rows[3].value is None


def test_bytes_are_protobuf(sensors, sensor):
    """The other implementation at hand reads our bytes, and its bytes are ours."""
    from google.protobuf import json_format

    cls = protobuf._message_class(sensor.descriptor_set, sensor.message)
    raw = bytes(sensors.head().value)
    assert json_format.MessageToDict(cls.FromString(raw)) == SENSOR_JSON
    assert json_format.ParseDict(SENSOR_JSON, cls()).SerializeToString(deterministic=True) == raw


def test_json_rules(sensors, sensor):
    texts = [r[0] for r in sensors.select(protobuf.to_json(F.col("m"), sensor)).collect()]
    assert json.loads(texts[0]) == SENSOR_JSON
    assert texts[1:] == ["{}", '{"location":{}}', None]


def test_encode_inverts_decode(sensors, sensor):
    again = sensors.select(F.col("value").eqNullSafe(protobuf.encode(F.col("m"), sensor)).alias("same"))
    assert all(r.same for r in again.collect())


WIDE = protobuf.describe(
    "wide",
    {
        "Inner": [("a", 1, "int64"), ("tags", 2, "repeated string")],
        "Wide": [
            ("u", 1, "uint64"), ("us", 2, "repeated uint64"), ("inners", 3, "repeated Inner"), ("one", 4, "Inner"),
            ("level", 5, "Level"), ("levels", 6, "repeated Level"), ("raw", 7, "bytes"), ("snake_name", 8, "float"),
            ("flag", 9, "bool"), ("small", 10, "int32"), ("u32", 11, "uint32"), ("by_name", 12, "map<string, Inner>"),
            ("by_number", 13, "map<int32, uint64>"),
        ],
    },
    {"Level": {"LOW": 0, "HIGH": 1}},
)


@pytest.fixture(scope="module")
def wide():
    return protobuf.ProtoType(WIDE, "wide.Wide")


JSON_CASES = [
    '{"u":"18446744073709551615","us":["1","18446744073709551614"],"inners":[{"a":"5","tags":["x","y"]},{}],'
    '"one":{"tags":["q"]},"level":"HIGH","levels":["LOW","HIGH"],"raw":"AQI=","snakeName":0.1,"flag":true,"small":-7,"u32":4294967295}',
    '{"u": 5, "snake_name": 2, "level": 1, "small": "12", "flag": false, "one": {"a": -9}}',
    '{"small": 3.0, "u32": 1e3, "one": {"a": "77", "unknown": {"deep": [1]}}, "other": null, "level": null, "us": []}',
    "{}",
    '{"inners": [{"a": "9223372036854775807"}], "raw": ""}',
    '{"byName": {"k": {"a": 1, "tags": ["t"]}, "l": {}}, "by_number": {"5": "18446744073709551615", "-1": 2}}',
]


def test_json_to_bytes_agrees_with_protobuf(spark, wide):
    from google.protobuf import json_format

    cls = protobuf._message_class(wide.descriptor_set, wide.message)
    rows = spark.createDataFrame(list(enumerate(JSON_CASES)), "id int, j string")
    got = rows.select("id", protobuf.json_to_bytes(F.col("j"), wide).alias("b")).orderBy("id")
    want = [json_format.Parse(t, cls(), ignore_unknown_fields=True).SerializeToString(deterministic=True) for t in JSON_CASES]
    assert [bytes(r.b) for r in got.collect()] == want


def test_to_json_agrees_with_protobuf(spark, wide):
    from google.protobuf import json_format

    cls = protobuf._message_class(wide.descriptor_set, wide.message)
    raw = [json_format.Parse(t, cls(), ignore_unknown_fields=True).SerializeToString() for t in JSON_CASES]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(raw)], "id int, b binary")
    got = rows.select("id", protobuf.bytes_to_json(F.col("b"), wide).alias("j")).orderBy("id").collect()
    want = [json_format.MessageToDict(cls.FromString(b)) for b in raw]
    assert [json.loads(r.j) for r in got] == want


def test_encode_inverts_decode_on_every_shape(spark, wide):
    rows = spark.createDataFrame(list(enumerate(JSON_CASES)), "id int, j string")
    rows = rows.select(protobuf.json_to_bytes(F.col("j"), wide).alias("b"))
    again = rows.withColumn("m", protobuf.decode(F.col("b"), wide)).select("b", protobuf.encode(F.col("m"), wide).alias("c"))
    assert all(bytes(r.b) == bytes(r.c) for r in again.collect())


def test_encode_goes_by_name(spark, sensor):
    row = spark.range(1).select(F.expr("named_struct('humidity', 5L, 'name', 'n', 'location', named_struct('y', 2))").alias("m"))
    back = row.select(protobuf.decode(protobuf.encode(F.col("m"), sensor), sensor).alias("m")).head().m
    assert (back.name, back.humidity, tuple(back.location), back.event) == ("n", 5, (0, 2), None)
    with pytest.raises(PySparkException, match="no field"):
        row.select(protobuf.encode(F.expr("named_struct('nope', 1)"), sensor)).collect()


def test_refused_messages():
    loop = protobuf.describe("loop", {"Node": [("next", 1, "Node")]})
    with pytest.raises(SpecError, match="contains itself"):
        protobuf.ProtoType(loop, "loop.Node").schema()


BAD_JSON = [
    "[1]", "{", "nonsense", '"text"', '{"small": "x"}', '{"small": 1.5}', '{"one": 5}', '{"u32": -1}', '{"u": "-1"}',
    '{"small": 2147483648}', '{"flag": "yes"}', '{"byNumber": {"x": 1}}', '{"inners": [{"a": "z"}]}', '{"raw": "%%%"}',
]


@pytest.mark.parametrize("text", BAD_JSON)
def test_bad_json(spark, wide, text):
    rows = spark.createDataFrame([(text,)], "j string")
    with pytest.raises(PySparkException):
        rows.select(protobuf.json_to_bytes(F.col("j"), wide)).collect()


@pytest.mark.parametrize("text", BAD_JSON)
def test_bad_json_skipped(spark, wide, text):
    rows = spark.createDataFrame([(text,), ('{"small": 4}',)], "j string")
    got = rows.select(protobuf.json_to_bytes(F.col("j"), wide, "skip")).collect()
    assert got[0][0] is None and got[1][0] is not None


def test_bad_bytes(spark, sensor):
    rows = spark.createDataFrame([(b"\xff\xff\xff",), (b"",)], "b binary")
    with pytest.raises(PySparkException):
        rows.select(protobuf.decode(F.col("b"), sensor)).collect()
    got = rows.select(protobuf.decode(F.col("b"), sensor, "skip").alias("m")).collect()
    assert got[0].m is None and got[1].m is not None


def test_registry(tmp_path, sensor):
    registry = bundled_protos.bundled()
    assert registry.names() == ["Sensor", "VideoAd"]
    (tmp_path / "s.desc").write_bytes(sensor.descriptor_set)
    registry.add_file("Again", tmp_path / "s.desc", sensor.message)
    assert registry.get("Again").schema() == sensor.schema()
    for name in ("Nope", None):
        with pytest.raises(SpecError):
            registry.get(name)
    with pytest.raises(SpecError):
        protobuf.ProtoType(sensor.descriptor_set, "sensors.Nope").schema()


# --- converters --------------------------------------------------------------------------------------------

P, J, L, S = DataType.PROTOBUF, DataType.JSON, DataType.LONG, DataType.STRING


def test_equal_types_need_no_converter():
    registry = ConverterRegistry()
    assert registry.choose(Conversion(J, J)) is None
    assert registry.choose(Conversion(P, P, "Sensor", "VideoAd", converter="proto-flat-json")) is None


@pytest.mark.parametrize(
    "job, text",
    [
        (Conversion(DataType.INTEGER, P), "no converter from INTEGER to PROTOBUF"),
        (Conversion(S, J), "no converter from STRING to JSON"),
        (Conversion(P, J, "Sensor", converter="nope"), "no converter is named"),
        (Conversion(J, P, None, "Sensor", converter="proto-flat-json"), "not JSON -> PROTOBUF"),
        (Conversion(P, J, "Sensor", converter="proto-flat-json"), "needs a known specific type"),
        (Conversion(P, J, "Nope"), "is not registered"),
        (Conversion(P, J, "VideoAd", converter="proto-flat-json", converter_type="sensor_flatted"), "no field"),
    ],
)
def test_refused_conversions(job, text):
    with pytest.raises(SpecError, match=text):
        ConverterRegistry().choose(job)


def test_flat_converter(sensors):
    job = Conversion(P, J, "Sensor", converter="proto-flat-json", converter_type="sensor_flatted")
    rows = convert(sensors.select("id", "value"), ConverterRegistry().choose(job)).orderBy("id").collect()
    assert json.loads(rows[0].value) == {
        "name_new": "Sensor Alfa", "humidity_new": 53, "door_state": "OPEN", "location_x": 231,
        "event_name": "Temperature Changed", "event_value": 5443,
    }
    assert json.loads(rows[1].value)["humidity_new"] == 0
    assert rows[3].value is None


def test_own_converters_and_trailer(spark):
    registry = ConverterRegistry()
    registry.add(L, S, lambda job: by_column(lambda v: F.concat(F.lit("n"), v.cast("string"))))
    registry.add_named(NamedConverter("loud", S, J, lambda job: by_column(F.upper)))
    rows = spark.createDataFrame([(1,)], "value bigint")
    trailer = spark.createDataFrame([("end",)], "value string")
    got = convert(rows, registry.choose(Conversion(L, S)), trailer=trailer)
    assert [r.value for r in got.collect()] == ["n1", "end"]
    assert [c["name"] for c in registry.list_named(Conversion(L, S))] == ["loud", "proto-flat-json"]
    assert "sensor_flatted" in registry.list_named(Conversion(L, S))[1]["specific_types"]


def test_text_behind_a_message_is_an_error(spark):
    proto = bundled_protos.bundled().get("Sensor")
    texts = spark.createDataFrame([('{"humidity":1}{"humidity":2}',), ('{"humidity":3}  ',)], "t string")
    got = texts.select(protobuf.from_json(F.col("t"), proto, "skip").alias("m")).select("m.humidity").collect()
    assert [r.humidity for r in got] == [None, 3]
    with pytest.raises(PySparkException, match="not the JSON"):
        texts.select(protobuf.from_json(F.col("t"), proto)).collect()


def test_bundled_columns_stand_in_the_given_order():
    names = [f.out for f in bundled_specs.bundled().get("ad_feedback_flatted_default").fields]
    assert names[:3] == ["abTestId", "adId", "adImpressId"] and len(names) == len(set(names)) == 125
