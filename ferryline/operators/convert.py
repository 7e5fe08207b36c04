"""Converters between the data types of a job's two sides, and how one is chosen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.operators import bundled_protos, bundled_specs, protobuf
from ferryline.operators.flatten import FlatSpecRegistry, flat_json, struct_columns
from ferryline.operators.protobuf import ProtoRegistry
from ferryline.types import DataType


@dataclass
class Conversion:
    """What a converter may need to know about the job it converts for."""

    source_type: DataType
    sink_type: DataType
    source_message: str | None = None
    sink_message: str | None = None
    converter: str | None = None
    converter_type: str | None = None
    args: Sequence[str] = ()
    on_error: str = "fail"
    protos: ProtoRegistry = field(default_factory=bundled_protos.bundled)
    specs: FlatSpecRegistry = field(default_factory=bundled_specs.bundled)


# A converter is made for one job and maps the whole DataFrame; it must leave the other columns alone.
Converter = Callable[[DataFrame, str], DataFrame]
Factory = Callable[[Conversion], Converter]


@dataclass(frozen=True)
class NamedConverter:
    name: str
    source_type: DataType
    sink_type: DataType
    make: Factory
    specific_types: Callable[[Conversion], Sequence[str]] = lambda job: ()


def by_column(change: Callable[[Column], Column]) -> Converter:
    """A converter that changes only the value column."""
    return lambda df, column: df.withColumn(column, change(F.col(column)))


def _proto_to_json(job: Conversion) -> Converter:
    proto = job.protos.get(job.source_message)
    return by_column(lambda value: protobuf.bytes_to_json(value, proto, job.on_error))


def _json_to_proto(job: Conversion) -> Converter:
    proto = job.protos.get(job.sink_message)
    return by_column(lambda value: protobuf.json_to_bytes(value, proto, job.on_error))


def _proto_to_flat_json(job: Conversion) -> Converter:
    proto = job.protos.get(job.source_message)
    if job.converter_type not in job.specs.names():
        raise SpecError(f"flat converter needs a known specific type, {job.converter_type!r} is not one")
    spec = job.specs.get(job.converter_type)
    schema = proto.schema()
    # Built once here so that a path the message does not have is refused before the job runs.
    struct_columns(schema, spec, F.col("value"))

    def convert(df: DataFrame, column: str) -> DataFrame:
        # The message is its own column first: the decoder runs once, not once per flat column.
        decoded = df.withColumn("_message", protobuf.decode(F.col(column), proto, job.on_error))
        text = flat_json(struct_columns(schema, spec, F.col("_message")))
        shown = F.when(F.col("_message").isNotNull(), text)
        return decoded.withColumn(column, shown).drop("_message")

    return convert


class ConverterRegistry:
    def __init__(self) -> None:
        self._by_types: dict[tuple[DataType, DataType], Factory] = {
            (DataType.PROTOBUF, DataType.JSON): _proto_to_json,
            (DataType.JSON, DataType.PROTOBUF): _json_to_proto,
        }
        self._named: dict[str, NamedConverter] = {}
        # Fixed value: the name job descriptions use.
        flat = NamedConverter(
            "proto-flat-json", DataType.PROTOBUF, DataType.JSON, _proto_to_flat_json, lambda job: job.specs.names()
        )
        self.add_named(flat)

    def add(self, source: DataType, sink: DataType, factory: Factory) -> None:
        self._by_types[source, sink] = factory

    def add_named(self, converter: NamedConverter) -> None:
        self._named[converter.name] = converter

    def list_named(self, job: Conversion) -> list[dict[str, object]]:
        return [
            {"name": c.name, "specific_types": list(c.specific_types(job))}
            for c in sorted(self._named.values(), key=lambda c: c.name)
        ]

    def choose(self, job: Conversion) -> Converter | None:
        """The converter for a job, or None when values pass unchanged.

        Equal types on both sides need no converter, and a named one is then ignored.
        """
        if job.source_type is job.sink_type:
            return None
        if job.converter is not None:
            named = self._named.get(job.converter)
            if named is None:
                raise SpecError(f"no converter is named {job.converter!r}")
            if (named.source_type, named.sink_type) != (job.source_type, job.sink_type):
                raise SpecError(
                    f"{named.name} converts {named.source_type.name} -> {named.sink_type.name},"
                    f" not {job.source_type.name} -> {job.sink_type.name}"
                )
            return named.make(job)
        factory = self._by_types.get((job.source_type, job.sink_type))
        if factory is None:
            raise SpecError(f"no converter from {job.source_type.name} to {job.sink_type.name}")
        return factory(job)


def convert(df: DataFrame, converter: Converter | None, column: str = "value", trailer: DataFrame | None = None) -> DataFrame:
    """Apply a chosen converter; ``trailer`` rows, if any, follow the converted ones."""
    converted = df if converter is None else converter(df, column)
    return converted if trailer is None else converted.unionByName(trailer, allowMissingColumns=True)
