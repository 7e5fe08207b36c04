"""Values to bytes and back, as column expressions.

``on_error='fail'`` raises on bytes that do not fit the type, ``'skip'`` gives null; ``dead_letters`` then
separates the rows that were skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.types import DataType

# Where the five groups of a UUID lie in its 16 bytes (from 1) and how long they are, per layout.
_UUID_GROUPS = {
    "rfc4122": ((1, 4), (5, 2), (7, 2), (9, 2), (11, 6)),
    "swapped": ((9, 4), (13, 2), (15, 2), (1, 2), (3, 6)),
}


def _check_layout(layout: str) -> None:
    if layout not in _UUID_GROUPS:
        raise SpecError(f"unknown uuid layout {layout!r}")


def _check_mode(on_error: str) -> None:
    if on_error not in ("fail", "skip"):
        raise SpecError("on_error must be 'fail' or 'skip'")


def _sized(value: Column, length: int, decoded: Column, kind: str, on_error: str) -> Column:
    """``decoded`` where ``value`` is ``length`` bytes long, null where it is null."""
    _check_mode(on_error)
    fits = F.octet_length(value) == length
    if on_error == "skip":
        return F.when(fits, decoded)
    problem = F.concat(F.octet_length(value).cast("string"), F.lit(f" bytes do not make a {kind}"))
    bad = F.when(value.isNotNull(), F.raise_error(problem).cast(kind if kind != "uuid" else "string"))
    return F.when(fits, decoded).otherwise(bad)


def encode_long(value: Column) -> Column:
    """8 bytes, big endian."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def decode_long(value: Column, on_error: str = "fail") -> Column:
    return _sized(value, 8, F.conv(F.hex(value), 16, -10).cast("bigint"), "bigint", on_error)


def encode_int(value: Column) -> Column:
    """4 bytes, big endian."""
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(8)))


def decode_int(value: Column, on_error: str = "fail") -> Column:
    unsigned = F.conv(F.hex(value), 16, 10).cast("bigint")
    signed = F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)
    return _sized(value, 4, signed.cast("int"), "int", on_error)


def encode_string(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def decode_string(value: Column, on_error: str = "fail") -> Column:
    _check_mode(on_error)
    if on_error == "skip":
        return F.try_validate_utf8(value.cast("string"))
    return F.validate_utf8(value.cast("string"))


def encode_uuid(value: Column, layout: str = "rfc4122") -> Column:
    """16 bytes. ``rfc4122`` keeps the text order; ``swapped`` puts the second half first.

    Some producers write the swapped form while readers expect the plain one; name the layout of the data.
    """
    _check_layout(layout)
    if layout == "swapped":
        value = F.concat(F.substring(value, 20, 17), F.substring(value, 1, 18))
    return F.unhex(F.replace(value, F.lit("-"), F.lit("")))


def decode_uuid(value: Column, layout: str = "rfc4122", on_error: str = "fail") -> Column:
    _check_layout(layout)
    groups = [F.hex(F.substring(value, start, length)) for start, length in _UUID_GROUPS[layout]]
    return _sized(value, 16, F.lower(F.concat_ws("-", *groups)), "uuid", on_error)


def encode(data_type: DataType, value: Column) -> Column:
    """Bytes of a value of a simple type; protobuf has its own codec."""
    encoders = {
        DataType.LONG: encode_long,
        DataType.INTEGER: encode_int,
        DataType.STRING: encode_string,
        DataType.UUID: encode_uuid,
        DataType.JSON: encode_string,
    }
    return encoders[data_type](value)


def decode(data_type: DataType, value: Column, on_error: str = "fail") -> Column:
    decoders = {
        DataType.LONG: decode_long,
        DataType.INTEGER: decode_int,
        DataType.STRING: decode_string,
        DataType.UUID: decode_uuid,
        DataType.JSON: decode_string,
    }
    return decoders[data_type](value, on_error=on_error)


def decode_records(rows: DataFrame, data_type: DataType, on_error: str = "fail", out: str = "decoded") -> DataFrame:
    """Decode ``value`` next to the record's other columns, so time and position travel on."""
    return rows.withColumn(out, decode(data_type, F.col("value"), on_error=on_error))


def dead_letters(rows: DataFrame, raw: str, decoded: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, skipped rows): a row was skipped when its bytes are there but its value is not."""
    skipped = F.col(raw).isNotNull() & F.col(decoded).isNull()
    return rows.filter(~skipped), rows.filter(skipped).drop(decoded)
