"""Protobuf messages as structs, bytes and JSON.

Only message bytes to columns and back needs protobuf itself; those two are Arrow UDFs over one column.
Everything else (reading and writing JSON by protobuf's rules, paths, flat columns) is ordinary expressions
over the struct, so it stays in the JVM. Where Spark's own protobuf package is on the class path, ``engine='native'``
decodes with it instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from google.protobuf import descriptor_pb2, descriptor_pool, message_factory
from google.protobuf.descriptor import Descriptor, FieldDescriptor
from google.protobuf.message import DecodeError, Message
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ferryline.errors import SpecError

FD = FieldDescriptor
_INT32 = {FD.TYPE_INT32, FD.TYPE_SINT32, FD.TYPE_SFIXED32}
_UINT32 = {FD.TYPE_UINT32, FD.TYPE_FIXED32}
_INT64 = {FD.TYPE_INT64, FD.TYPE_SINT64, FD.TYPE_SFIXED64}
_UINT64 = {FD.TYPE_UINT64, FD.TYPE_FIXED64}


@dataclass(frozen=True)
class ProtoType:
    """A message type: a serialized FileDescriptorSet and the message's full name in it.

    Message classes do not travel to executors, so tasks rebuild them from these bytes.
    """

    descriptor_set: bytes
    message: str

    @property
    def descriptor(self) -> Descriptor:
        return _message_class(self.descriptor_set, self.message).DESCRIPTOR

    def schema(self) -> T.StructType:
        descriptor = self.descriptor
        _check_shape(descriptor, ())
        return _struct_type(descriptor)


class ProtoRegistry:
    """Message types by the name a job description uses."""

    def __init__(self) -> None:
        self._types: dict[str, ProtoType] = {}

    def add(self, name: str, proto: ProtoType) -> None:
        self._types[name] = proto

    def add_file(self, name: str, descriptor_file: str | Path, message: str) -> None:
        """Register a message of a descriptor set file as a protobuf compiler writes it."""
        self.add(name, ProtoType(Path(descriptor_file).read_bytes(), message))

    def get(self, name: str | None) -> ProtoType:
        if name not in self._types:
            raise SpecError(f"protobuf type {name!r} is not registered")
        return self._types[name]

    def names(self) -> Sequence[str]:
        return sorted(self._types)


def _message_class(descriptor_set: bytes, message: str) -> type[Message]:
    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptor_set).file:
        pool.Add(file)
    try:
        return message_factory.GetMessageClass(pool.FindMessageTypeByName(message))
    except KeyError:
        raise SpecError(f"message {message!r} is not in the descriptor set") from None


def _built_once(built: list[type[Message]], descriptor_set: bytes, message: str) -> type[Message]:
    """The class kept in a task's own ``built``, which is empty when the task is sent out."""
    if not built:
        built.append(_message_class(descriptor_set, message))
    return built[0]


def _set_type(
    field: descriptor_pb2.FieldDescriptorProto, kind: str, package: str, messages: Mapping, enums: Mapping
) -> None:
    if kind in messages or kind in enums:
        field.type = FD.TYPE_MESSAGE if kind in messages else FD.TYPE_ENUM
        field.type_name = f".{package}.{kind}"
    else:
        field.type = getattr(FD, f"TYPE_{kind.upper()}")


def describe(
    package: str,
    messages: Mapping[str, Iterable[tuple[str, int, str]]],
    enums: Mapping[str, Mapping[str, int]] | None = None,
) -> bytes:
    """A proto3 descriptor set from (field, number, type) lists, for use without a protobuf compiler.

    A type is a scalar name, a message or enum name of the same set, ``repeated <type>`` or
    ``map<scalar, type>``.
    """
    file = descriptor_pb2.FileDescriptorProto(name=f"{package}.proto", package=package, syntax="proto3")
    enums = enums or {}
    for name, values in enums.items():
        enum = file.enum_type.add(name=name)
        for label, number in values.items():
            enum.value.add(name=label, number=number)
    for name, fields in messages.items():
        message = file.message_type.add(name=name)
        for label, number, kind in fields:
            field = message.field.add(name=label, number=number, label=FD.LABEL_OPTIONAL)
            if kind.startswith(("repeated ", "map<")):
                field.label = FD.LABEL_REPEATED
            if kind.startswith("map<"):
                entry = message.nested_type.add(name=label.title().replace("_", "") + "Entry")
                entry.options.map_entry = True
                for part, (side, of) in enumerate(zip(("key", "value"), kind[4:-1].split(",")), start=1):
                    inner = entry.field.add(name=side, number=part, label=FD.LABEL_OPTIONAL)
                    _set_type(inner, of.strip(), package, messages, enums)
                field.type, field.type_name = FD.TYPE_MESSAGE, f".{package}.{name}.{entry.name}"
            else:
                _set_type(field, kind.removeprefix("repeated "), package, messages, enums)
    return descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString()


# --- types -------------------------------------------------------------------------------------------------


def _check_shape(descriptor: Descriptor, outer: tuple[str, ...]) -> None:
    """Refuse messages without a struct form: ones that contain themselves, and protobuf's own special ones."""
    name = descriptor.full_name
    if name in outer:
        raise SpecError(f"message {name} contains itself")
    if name.startswith("google.protobuf."):
        raise SpecError(f"message {name} is not supported")
    for field in descriptor.fields:
        if field.type == FD.TYPE_MESSAGE:
            _check_shape(field.message_type, (*outer, name))


def _is_map(field: FieldDescriptor) -> bool:
    return field.message_type is not None and field.message_type.GetOptions().map_entry


def _scalar_type(field: FieldDescriptor) -> T.DataType:
    if field.type == FD.TYPE_MESSAGE:
        return _struct_type(field.message_type)
    if field.type in _INT32:
        return T.IntegerType()
    # Unsigned 32 bit fits a long; unsigned 64 bit keeps its bits, so values past 2^63 read as negative.
    if field.type in _UINT32 | _INT64 | _UINT64:
        return T.LongType()
    names = {FD.TYPE_BOOL: T.BooleanType(), FD.TYPE_FLOAT: T.FloatType(), FD.TYPE_DOUBLE: T.DoubleType()}
    names |= {FD.TYPE_BYTES: T.BinaryType(), FD.TYPE_STRING: T.StringType(), FD.TYPE_ENUM: T.StringType()}
    if field.type not in names:
        raise SpecError(f"field {field.full_name} has a type that is not supported")
    return names[field.type]


def _field_type(field: FieldDescriptor) -> T.DataType:
    if _is_map(field):
        entry = field.message_type.fields_by_name
        return T.MapType(_scalar_type(entry["key"]), _scalar_type(entry["value"]))
    return T.ArrayType(_scalar_type(field)) if field.is_repeated else _scalar_type(field)


def _struct_type(descriptor: Descriptor) -> T.StructType:
    return T.StructType([T.StructField(f.name, _field_type(f)) for f in descriptor.fields])


# --- bytes <-> struct --------------------------------------------------------------------------------------


def _value_array(values: list[Any], field: FieldDescriptor) -> pa.Array:
    """Values of one field, already taken from their messages, as an Arrow column."""
    if field.type == FD.TYPE_MESSAGE:
        return _struct_array(values, field.message_type)
    if field.type == FD.TYPE_ENUM:
        names = {v.number: v.name for v in field.enum_type.values}
        values = [None if v is None else names.get(v, str(v)) for v in values]
    elif field.type in _UINT64:
        values = [v - (1 << 64) if v is not None and v >= 1 << 63 else v for v in values]
    return pa.array(values, type=to_arrow_type(_scalar_type(field)))


def _flat(groups: list[Any]) -> tuple[pa.Array, list[Any]]:
    """List offsets and concatenated items of groups of which some may be None."""
    offsets, items = [0], []
    for group in groups:
        items.extend(group or ())
        offsets.append(len(items))
    return pa.array(offsets, pa.int32()), items


def _field_array(messages: list[Message | None], field: FieldDescriptor) -> pa.Array:
    name = field.name
    if _is_map(field):
        entry = field.message_type.fields_by_name
        offsets, pairs = _flat([None if m is None else list(getattr(m, name).items()) for m in messages])
        keys, values = ([k for k, _ in pairs], [v for _, v in pairs])
        return pa.MapArray.from_arrays(offsets, _value_array(keys, entry["key"]), _value_array(values, entry["value"]))
    if field.is_repeated:
        offsets, items = _flat([None if m is None else getattr(m, name) for m in messages])
        return pa.ListArray.from_arrays(offsets, _value_array(items, field))
    if field.has_presence:
        set_in = [m is not None and m.HasField(name) for m in messages]
        return _value_array([getattr(m, name) if there else None for m, there in zip(messages, set_in)], field)
    return _value_array([None if m is None else getattr(m, name) for m in messages], field)


def _struct_array(messages: list[Message | None], descriptor: Descriptor) -> pa.Array:
    """Messages as one struct column, built field by field."""
    fields = to_arrow_type(_struct_type(descriptor))
    missing = pa.array([m is None for m in messages], pa.bool_())
    columns = [_field_array(messages, f).cast(fields[i].type) for i, f in enumerate(descriptor.fields)]
    return pa.StructArray.from_arrays(columns, fields=list(fields), mask=missing)


def decode(value: Column, proto: ProtoType, on_error: str = "fail", engine: str = "arrow") -> Column:
    """Message bytes as a struct.

    Fields without presence are always set (0, '' or false by default), unset sub-messages and optional
    fields are null. With ``on_error='skip'`` bad bytes give null.
    """
    if engine == "native":
        from pyspark.sql.protobuf.functions import from_protobuf

        mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
        options = {"mode": mode, "emit.default.values": "true"}
        return from_protobuf(value, proto.message, binaryDescriptorSet=proto.descriptor_set, options=options)
    descriptor_set, message = proto.descriptor_set, proto.message
    built: list[type[Message]] = []

    def parse(values: pa.Array) -> pa.Array:
        cls = _built_once(built, descriptor_set, message)

        def one(raw: bytes | None) -> Message | None:
            if raw is None:
                return None
            try:
                return cls.FromString(raw)
            except DecodeError:
                if on_error == "fail":
                    raise
                return None

        return _struct_array([one(v) for v in values.to_pylist()], cls.DESCRIPTOR)

    return F.arrow_udf(parse, proto.schema())(value).alias("message")


def _item_values(array: pa.Array, field: FieldDescriptor) -> list[Any]:
    """An Arrow column of single values as what a message constructor takes."""
    if field.type == FD.TYPE_MESSAGE:
        return _row_values(array, field.message_type)
    values = array.to_pylist()
    if field.type in _UINT64:
        return [v + (1 << 64) if v is not None and v < 0 else v for v in values]
    if field.type == FD.TYPE_ENUM:
        known = field.enum_type.values_by_name
        return [v if v is None or v in known else int(v) for v in values]
    return values


def _field_values(array: pa.Array, field: FieldDescriptor) -> list[Any]:
    if not field.is_repeated:
        return _item_values(array, field)
    bounds, valid = array.offsets.to_pylist(), array.is_valid().to_pylist()
    spans = [(low, high) if ok else None for low, high, ok in zip(bounds[:-1], bounds[1:], valid)]
    if _is_map(field):
        entry = field.message_type.fields_by_name
        keys, items = _item_values(array.keys, entry["key"]), _item_values(array.items, entry["value"])
        return [s and dict(zip(keys[slice(*s)], items[slice(*s)])) for s in spans]
    items = _item_values(array.values, field)
    return [s and items[slice(*s)] for s in spans]


def _row_values(array: pa.Array, descriptor: Descriptor) -> list[dict[str, Any] | None]:
    """A struct column as one dict per row, taken field by field; fields go by their names."""
    names = [f.name for f in array.type]
    unknown = set(names) - set(descriptor.fields_by_name)
    if unknown:
        raise SpecError(f"message {descriptor.full_name} has no field {sorted(unknown)}")
    columns = [_field_values(c, descriptor.fields_by_name[n]) for c, n in zip(array.flatten(), names)]
    rows = [dict(zip(names, values)) for values in zip(*columns)] if columns else [{} for _ in range(len(array))]
    if array.null_count == 0:
        return rows
    return [row if ok else None for row, ok in zip(rows, array.is_valid().to_pylist())]


def encode(struct: Column, proto: ProtoType) -> Column:
    """A struct as message bytes. Its fields go by name and may be some of the message's; null ones stay unset."""
    descriptor_set, message = proto.descriptor_set, proto.message
    built: list[type[Message]] = []

    def build(rows: pa.Array) -> pa.Array:
        cls = _built_once(built, descriptor_set, message)
        values = _row_values(rows, cls.DESCRIPTOR)
        encoded = [None if v is None else cls(**v).SerializeToString(deterministic=True) for v in values]
        return pa.array(encoded, type=pa.binary())

    return F.arrow_udf(build, T.BinaryType())(struct).alias("value")


# --- JSON -> struct ----------------------------------------------------------------------------------------


def _json_type(descriptor: Descriptor) -> T.StructType:
    """How JSON of a message is first read: its shape, with every scalar as text.

    Text takes numbers, quoted numbers and names alike, which is what protobuf's JSON mapping allows. A field
    may go by its lowerCamel name or by its own.
    """
    fields = []
    for field in descriptor.fields:
        kind: T.DataType
        if _is_map(field):
            kind = T.MapType(T.StringType(), _json_item_type(field.message_type.fields_by_name["value"]))
        else:
            kind = T.ArrayType(_json_item_type(field)) if field.is_repeated else _json_item_type(field)
        fields += [T.StructField(name, kind) for name in dict.fromkeys([field.json_name, field.name])]
    return T.StructType(fields)


def _json_item_type(field: FieldDescriptor) -> T.DataType:
    return _json_type(field.message_type) if field.type == FD.TYPE_MESSAGE else T.StringType()


def _bounds(field: FieldDescriptor) -> tuple[int, int] | None:
    for types, low, high in (
        (_INT32, -(1 << 31), (1 << 31) - 1),
        (_UINT32, 0, (1 << 32) - 1),
        (_INT64, -(1 << 63), (1 << 63) - 1),
        (_UINT64, 0, (1 << 64) - 1),
    ):
        if field.type in types:
            return low, high
    return None


def _whole(text: Column) -> Column:
    """The text as a decimal if it is an integer, also one written like ``1.0`` or ``1e3``; else null."""
    wide = text.try_cast("decimal(38,9)")
    return F.when(wide == F.floor(wide), F.floor(wide).cast("decimal(29,0)"))


def _fits(text: Column, field: FieldDescriptor) -> Column:
    """Whether a text can be read as the field's type."""
    bounds = _bounds(field)
    if bounds is not None:
        low, high = (F.lit(str(n)).cast("decimal(29,0)") for n in bounds)
        fits = F.coalesce(_whole(text).between(low, high), F.lit(False))
    elif field.type == FD.TYPE_BYTES:
        fits = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64")).isNotNull()
    elif field.type == FD.TYPE_BOOL:
        fits = text.isin("true", "false")
    elif field.type in (FD.TYPE_FLOAT, FD.TYPE_DOUBLE):
        fits = text.try_cast("double").isNotNull()
    else:
        return F.lit(True)
    return text.isNull() | fits


def _fields_fit(read: Column, descriptor: Descriptor) -> Column:
    """Whether every text of a message can be read."""
    fit = F.lit(True)
    for field in descriptor.fields:
        value = _named(read, field)
        if _is_map(field):
            entry = field.message_type.fields_by_name
            fit = fit & F.coalesce(F.forall(F.map_entries(value), _entry_fits(entry["key"], entry["value"])), F.lit(True))
        elif field.is_repeated:
            fit = fit & F.coalesce(F.forall(value, _item_fits(field)), F.lit(True))
        else:
            fit = fit & _item_fits(field)(value)
    return fit


def _item_fits(field: FieldDescriptor) -> Callable[[Column], Column]:
    if field.type == FD.TYPE_MESSAGE:
        return lambda item: item.isNull() | _fields_fit(item, field.message_type)
    return lambda item: _fits(item, field)


def _entry_fits(key: FieldDescriptor, value: FieldDescriptor) -> Callable[[Column], Column]:
    return lambda e: _item_fits(key)(e["key"]) & _item_fits(value)(e["value"])


def _read_number(text: Column, field: FieldDescriptor) -> Column:
    kind = _scalar_type(field)
    low, _ = _bounds(field)
    # Up to nine digits fit every integer type, and are nearly all there is.
    short = text.rlike(r"^-?[0-9]{1,9}$" if low else r"^[0-9]{1,9}$")
    exact = _whole(text)
    if field.type in _UINT64:
        wrap = F.lit(str(1 << 64)).cast("decimal(29,0)")
        exact = F.when(exact >= F.lit(str(1 << 63)).cast("decimal(29,0)"), exact - wrap).otherwise(exact)
    lost = F.raise_error(F.concat(F.lit(f"{field.name} does not take "), text)).cast(kind)
    return F.when(text.isNull(), F.lit(None)).when(short, text.cast(kind)).when(_fits(text, field), exact.cast(kind)).otherwise(lost)


def _read_item(text: Column, field: FieldDescriptor) -> Column:
    if field.type == FD.TYPE_MESSAGE:
        return F.when(text.isNotNull(), F.struct(*_read_fields(text, field.message_type)))
    if field.type == FD.TYPE_ENUM:
        labels = {str(v.number): v.name for v in field.enum_type.values}
        label = F.when(text.isin(list(labels.values())), text)
        for number, name in labels.items():
            label = F.when(text == number, F.lit(name)).otherwise(label)
        # An unknown name leaves the field unset; an unknown number is kept as it is.
        return F.coalesce(label, F.when(text.rlike("^-?[0-9]+$"), text))
    if _bounds(field) is not None:
        return _read_number(text, field)
    if field.type == FD.TYPE_BYTES:
        return F.to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    if field.type == FD.TYPE_BOOL:
        # A plain cast would take other words too.
        lost = F.raise_error(F.concat(F.lit(f"{field.name} does not take "), text)).cast("boolean")
        return F.when(text.isNull(), F.lit(None)).when(text.isin("true", "false"), text == "true").otherwise(lost)
    return text.cast(_scalar_type(field))


def _named(read: Column, field: FieldDescriptor) -> Column:
    """A field by its lowerCamel name or its own."""
    names = list(dict.fromkeys([field.json_name, field.name]))
    return F.coalesce(*[read.getField(n) for n in names]) if len(names) > 1 else read.getField(names[0])


def _read_fields(read: Column, descriptor: Descriptor) -> list[Column]:
    columns = []
    for field in descriptor.fields:
        value = _named(read, field)
        if _is_map(field):
            entry = field.message_type.fields_by_name
            value = F.map_from_entries(F.transform(F.map_entries(value), _read_entry(entry["key"], entry["value"])))
        else:
            value = F.transform(value, _read_one(field)) if field.is_repeated else _read_item(value, field)
        columns.append(value.alias(field.name))
    return columns


def _read_one(field: FieldDescriptor) -> Callable[[Column], Column]:
    return lambda item: _read_item(item, field)


def _read_entry(key: FieldDescriptor, value: FieldDescriptor) -> Callable[[Column], Column]:
    return lambda e: F.struct(_read_item(e["key"], key).alias("key"), _read_item(e["value"], value).alias("value"))


_BAD_JSON = "_bad"


def _is_one_value(text: Column) -> Column:
    """Whether nothing follows the first JSON value: inside brackets it is then the whole of an array of one."""
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def from_json(text: Column, proto: ProtoType, on_error: str = "fail") -> Column:
    """JSON text as the message's struct; unknown fields are ignored, absent and null ones are null.

    Text that is not a JSON object of the message's shape raises, or with ``on_error='skip'`` gives null.
    """
    shape = T.StructType([*_json_type(proto.descriptor).fields, T.StructField(_BAD_JSON, T.StringType())])
    read = F.from_json(text, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD_JSON})
    problem = F.raise_error(F.concat(F.lit("not the JSON of a message: "), F.left(text, F.lit(80))))
    failure = F.lit(None) if on_error == "skip" else problem

    def message(read: Column) -> Column:
        good = read.getField(_BAD_JSON).isNull() & text.rlike(r"^\s*\{") & _is_one_value(text)
        if on_error == "skip":
            good = good & _fields_fit(read, proto.descriptor)
        fields = F.struct(*_read_fields(read, proto.descriptor))
        return F.when(text.isNull(), F.lit(None)).when(good, fields).otherwise(failure.cast(proto.schema()))

    # A lambda over a one-element array names the parsed text, so it is parsed once and not once per field.
    return F.get(F.transform(F.array(read), message), 0).alias("message")


def json_to_bytes(text: Column, proto: ProtoType, on_error: str = "fail") -> Column:
    """JSON text (protobuf's JSON mapping) as message bytes."""
    return encode(from_json(text, proto, on_error), proto)


# --- struct -> JSON ----------------------------------------------------------------------------------------


def _json_scalar(value: Column, field: FieldDescriptor) -> Column:
    if field.type == FD.TYPE_MESSAGE:
        return F.when(value.isNotNull(), F.struct(*_json_fields(value, field.message_type)))
    if field.type in _INT64:
        return value.cast("string")
    if field.type in _UINT64:
        unsigned = value.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")
        return F.when(value < 0, unsigned.cast("string")).otherwise(value.cast("string"))
    return value


def _json_item(field: FieldDescriptor) -> Callable[[Column], Column]:
    return lambda item: _json_scalar(item, field)


def _json_entry(field: FieldDescriptor) -> Callable[[Column], Column]:
    return lambda e: F.struct(e["key"].cast("string").alias("key"), _json_scalar(e["value"], field).alias("value"))


def _json_fields(struct: Column, descriptor: Descriptor) -> list[Column]:
    columns = []
    for field in descriptor.fields:
        value = struct.getField(field.name)
        if _is_map(field):
            entry = field.message_type.fields_by_name
            shown = F.map_from_entries(F.transform(F.map_entries(value), _json_entry(entry["value"])))
            shown = F.when(F.size(value) > 0, shown)
        elif field.is_repeated:
            shown = F.when(F.size(value) > 0, F.transform(value, _json_item(field)))
        elif field.has_presence:
            shown = _json_scalar(value, field)
        else:
            shown = F.when(value != _zero(field), _json_scalar(value, field))
        columns.append(shown.alias(field.json_name))
    return columns


def _zero(field: FieldDescriptor) -> Column:
    if field.type == FD.TYPE_ENUM:
        return F.lit(next(v.name for v in field.enum_type.values if v.number == 0))
    return F.lit(b"") if field.type == FD.TYPE_BYTES else F.lit(field.default_value)


def to_json(struct: Column, proto: ProtoType) -> Column:
    """A decoded message as JSON by protobuf's mapping.

    Zero values without presence and empty lists are left out, 64-bit integers are texts, enums are names,
    names are lowerCamel.
    """
    text = F.to_json(F.struct(*_json_fields(struct, proto.descriptor)), {"ignoreNullFields": "true"})
    return F.when(struct.isNotNull(), text).alias("json")


def bytes_to_json(value: Column, proto: ProtoType, on_error: str = "fail", engine: str = "arrow") -> Column:
    return to_json(decode(value, proto, on_error, engine), proto)
