import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline import SpecError
from ferryline.functions import codecs, scalars, units
from ferryline.functions.paths import struct_path
from ferryline.types import DataType, Platform, carries, check_side


def one(spark, column):
    return spark.range(1).select(column.alias("c")).head().c


def many(spark, values, kind, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", function(F.col("v")).alias("c"))
    return [r.c for r in rows.orderBy("i").collect()]


# --- sizes and durations -----------------------------------------------------------------------------------

SIZES = {
    "1024 b": 1024,
    "1024B": 1024,
    "\t1024   B\t": 1024,
    "1024kB": 1024**2,
    "1024 KiB": 1024**2,
    "1024 kib": 1024**2,
    "3 Kb": 3 * 1024,
    "5MB": 5 * 1024**2,
    "5 mib": 5 * 1024**2,
    "150 mb": 150 * 1024**2,
    "7 Gib": 7 * 1024**3,
    "2TB": 2 * 1024**4,
    "0 B": 0,
    "000000000000000000000000000012 B": 12,
    "9223372036854775807B": 2**63 - 1,
}
BAD_SIZES = ["-1", "1024", "1024 Wb", "", "kB", "1 KIB", "1.5 kB", "9223372036854775808B", "9007199254740992 KB", "1 k", "-1 B"]


def test_size_column(spark):
    assert many(spark, list(SIZES), "string", units.parse_size) == list(SIZES.values())
    assert many(spark, [*BAD_SIZES, None], "string", lambda c: units.parse_size(c, strict=False)) == [None] * (len(BAD_SIZES) + 1)


@pytest.mark.parametrize("text", [*BAD_SIZES, None])
def test_bad_size_raises(spark, text):
    with pytest.raises(PySparkException):
        one(spark, units.parse_size(F.lit(text).cast("string")))


def test_size_option():
    assert [units.size_option(t) for t in SIZES] == list(SIZES.values())
    for text in BAD_SIZES:
        with pytest.raises(SpecError):
            units.size_option(text)


def test_size_format(spark):
    size = F.lit(5 * 1024**2 + 1).cast("bigint")
    assert one(spark, units.to_unit(size, "MB")) == 5
    assert one(spark, units.format_size(size, "KB")) == "5120KB"
    assert one(spark, units.format_size(size)) == "5242881B"
    with pytest.raises(SpecError):
        units.to_unit(size, "PB")


DURATIONS = {
    "2 d": 2 * 86_400 * 10**9, "2days": 2 * 86_400 * 10**9, "3 hour": 3 * 3600 * 10**9, "1 m": 60 * 10**9,
    "1 min": 60 * 10**9, "10 minutes": 600 * 10**9, "5 s": 5 * 10**9, "5 sec": 5 * 10**9, "5 seconds": 5 * 10**9,
    "7 ms": 7 * 10**6, "7 millis": 7 * 10**6, "7 milisec": 7 * 10**6, "8 us": 8000, "8 micros": 8000, "8 microsec": 8000,
    "9 ns": 9, "9 nanos": 9, "9 nanoseconds": 9,
}
BAD_DURATIONS = ["5", "5 D", " 5 s", "5 s ", "5 weeks", "-5 s", "5 millis5"]


def test_duration(spark):
    assert many(spark, list(DURATIONS), "string", units.parse_duration) == list(DURATIONS.values())
    assert many(spark, ["", None], "string", units.parse_duration) == [None, None]
    assert [units.duration_option(t) for t in DURATIONS] == list(DURATIONS.values())
    assert units.duration_option("") is None and units.duration_option(None) is None
    assert many(spark, BAD_DURATIONS, "string", lambda c: units.parse_duration(c, strict=False)) == [None] * len(BAD_DURATIONS)
    for text in BAD_DURATIONS:
        with pytest.raises(SpecError):
            units.duration_option(text)
        with pytest.raises(PySparkException):
            one(spark, units.parse_duration(F.lit(text)))


# --- scalars -----------------------------------------------------------------------------------------------


def test_feature_arithmetic(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scalars.sum_float(F.lit(1.5), null, F.lit(2))) == 3.5
    assert one(spark, scalars.multiply_float(F.lit(1.5), F.lit(2))) == 3.0
    assert one(spark, scalars.multiply_float(F.lit(1.5), null)) == 0.0
    assert dict(spark.range(1).select(scalars.sum_float(F.lit(1)).alias("c")).dtypes)["c"] == "float"
    assert many(spark, [True, False, None], "boolean", scalars.bool_to_int) == [1, 0, 0]


def test_array_ids(spark):
    assert many(spark, [[1, 2, 3], [], None], "array<bigint>", scalars.array_ids_flatten) == ["1,2,3", "", ""]


def test_array_search(spark):
    items = F.expr(
        "array(named_struct('name', 'a', 'value', 1.0D), named_struct('name', 'b', 'value', 2.0D),"
        " named_struct('name', 'a', 'value', 3.0D))"
    )
    assert one(spark, scalars.search_in_array(items, "a", "value")) == 1.0
    assert one(spark, scalars.search_in_array(items, "z", "value")) is None


def test_time_helpers(spark):
    assert many(spark, [0, 3_600_000 * 25, -1], "bigint", scalars.hour_of_day) == [0, 1, 23]
    assert one(spark, scalars.same_second(F.lit(1000), F.lit(1999)))
    assert not one(spark, scalars.same_second(F.lit(1999), F.lit(2000)))
    micros = scalars.micros_to_timestamp(F.lit(1_704_067_200_123_456).cast("bigint"))
    assert one(spark, F.date_format(micros, "yyyy-MM-dd HH:mm:ss.SSSSSS")) == "2024-01-01 00:00:00.123456"


def test_text_helpers(spark):
    parts = [["a", None, "", "b"], [], [None], None]
    assert many(spark, parts, "array<string>", lambda c: scalars.join_nullable("-", c)) == ["a-b", "", "", "null"]
    texts = [None, "", " \t\n \x1c", " x ", " ", "\n"]
    assert many(spark, texts, "string", scalars.is_blank) == [True, True, True, False, False, True]
    assert many(spark, texts, "string", scalars.is_not_blank) == [False, False, False, True, True, False]
    paths = ["///a/b//", "a", "/", ""]
    assert many(spark, paths, "string", scalars.strip_leading_slashes) == ["a/b//", "a", "", ""]
    assert many(spark, paths, "string", scalars.strip_ending_slashes) == ["///a/b", "a", "", ""]


QUERIES = {
    "http://h/p?a=1&b=2": {"a": "1", "b": "2"},
    "http://h/p": {},
    "http://h/p?": {},
    "http://h/p?&": {},
    "http://h/p?a=&b&=c&a=3": {"a": "3", "b": None, "=c": None},
    "http://h/p?a=1&a=": {"a": None},
    "http://h/p?q=a%20b%26c+d&x=1=2#f?y=1": {"q": "a b&c d", "x": "1=2"},
    "http://h/p?a=1&&b=2&&": {"a": "1", "": None, "b": "2"},
    "/only/path?k=v": {"k": "v"},
    None: None,
}


def test_split_query(spark):
    got = many(spark, list(QUERIES), "string", scalars.split_query)
    assert got[:-1] == list(QUERIES.values())[:-1] and not got[-1]


def test_function_registry():
    registry = scalars.default_registry()
    registry.add("double", lambda c: c * 2)
    assert "double" in registry.names() and "sumFloat" in registry.names()
    with pytest.raises(SpecError):
        registry.get("transformStats")


# --- codecs ------------------------------------------------------------------------------------------------

LONGS = [0, 1, -1, 2**63 - 1, -(2**63), 255, -256, None]
INTS = [0, 1, -1, 2**31 - 1, -(2**31), -2, None]


def test_long_and_int(spark):
    want = [None if v is None else v.to_bytes(8, "big", signed=True) for v in LONGS]
    assert [b and bytes(b) for b in many(spark, LONGS, "bigint", codecs.encode_long)] == want
    assert many(spark, LONGS, "bigint", lambda c: codecs.decode_long(codecs.encode_long(c))) == LONGS
    want = [None if v is None else v.to_bytes(4, "big", signed=True) for v in INTS]
    assert [b and bytes(b) for b in many(spark, INTS, "int", codecs.encode_int)] == want
    assert many(spark, INTS, "int", lambda c: codecs.decode_int(codecs.encode_int(c))) == INTS


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50))
def test_long_roundtrip(spark, values):
    assert many(spark, values, "bigint", lambda c: codecs.decode_long(codecs.encode_long(c))) == values


def test_uuid_layouts(spark):
    text = "00112233-4455-6677-8899-aabbccddeeff"
    plain = bytes(one(spark, codecs.encode_uuid(F.lit(text))))
    assert plain == uuid.UUID(text).bytes
    assert bytes(one(spark, codecs.encode_uuid(F.lit(text), "swapped"))) == plain[8:] + plain[:8]
    for layout in ("rfc4122", "swapped"):
        assert one(spark, codecs.decode_uuid(codecs.encode_uuid(F.lit(text), layout), layout)) == text
    with pytest.raises(SpecError):
        codecs.encode_uuid(F.lit(text), "other")


@pytest.mark.parametrize("decode", [codecs.decode_long, codecs.decode_int, codecs.decode_uuid])
def test_wrong_length(spark, decode):
    short = F.lit(b"abc")
    assert one(spark, decode(short, on_error="skip")) is None
    with pytest.raises(PySparkException):
        one(spark, decode(short))
    assert one(spark, decode(F.lit(None).cast("binary"))) is None


def test_bad_utf8(spark):
    assert one(spark, codecs.decode_string(F.lit(b"\xff\xfe"), "skip")) is None
    with pytest.raises(PySparkException):
        one(spark, codecs.decode_string(F.lit(b"\xff\xfe")))


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, b"12345678"), (2, b"x"), (3, None)], "id int, value binary")
    good, bad = codecs.dead_letters(codecs.decode_records(rows, DataType.LONG, "skip"), "value", "decoded")
    assert sorted(r.id for r in good.collect()) == [1, 3] and [r.id for r in bad.collect()] == [2]


@pytest.mark.parametrize("kind", [t for t in DataType if t is not DataType.PROTOBUF])
def test_every_simple_type_round_trips(spark, kind):
    values = {"long": "5L", "int": "5", "string": "'é'", "json": "'{}'", "uuid": "'00112233-4455-6677-8899-aabbccddeeff'"}
    value = F.expr(values[kind.value])
    assert one(spark, codecs.decode(kind, codecs.encode(kind, value))) == one(spark, value)


# --- types -------------------------------------------------------------------------------------------------


def test_platform_matrix():
    assert all(carries(Platform.KAFKA, t) for t in DataType)
    for platform in (Platform.S3, Platform.HDFS, Platform.LOCAL_FS):
        assert {t for t in DataType if carries(platform, t)} == {DataType.JSON, DataType.PROTOBUF}
    check_side(Platform.LOCAL_FS, DataType.JSON, "sink")
    with pytest.raises(SpecError):
        check_side(Platform.LOCAL_FS, DataType.JSON, "source")
    with pytest.raises(SpecError):
        check_side(Platform.S3, DataType.LONG, "sink")
    with pytest.raises(SpecError):
        Platform.parse("FTP")
    with pytest.raises(SpecError):
        DataType.parse("decimal")


def test_a_missing_element_has_no_default(spark):
    schema = T.StructType.fromDDL("w array<string>, s array<struct<a:int>>")
    row = spark.createDataFrame([(["x", None], [(None,)]), (None, None)], schema)
    paths = {"past": "w.[5]", "null": "w.[1]", "there": "s.[0].a", "gone": "s.[1].a"}
    got = row.select(*[struct_path(schema, p).alias(n) for n, p in paths.items()]).collect()
    assert tuple(got[0]) == (None, "", 0, None) and tuple(got[1]) == (None, None, None, None)


def test_undecodable_query_values(spark):
    url = spark.createDataFrame([("http://h/p?q=100%&r=a%20b",)], "url string")
    with pytest.raises(PySparkException):
        url.select(scalars.query_pairs(F.col("url"))).collect()
    pairs = url.select(scalars.query_pairs(F.col("url"), on_error="skip")).head()[0]
    assert [tuple(p) for p in pairs] == [("q", None), ("r", "a b")]
