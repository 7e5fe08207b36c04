"""Flat specs: a declarative projection of nested records onto flat columns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.errors import SpecError
from ferryline.functions.paths import resolve_type, struct_path, variant_path
from ferryline.functions.scalars import FunctionRegistry, default_registry, pick_by_name


@dataclass(frozen=True)
class FlatField:
    """One flat column: where its value comes from, an optional function, and a default."""

    out: str
    path: str
    function: str | None = None
    selectors: str | None = None
    default: Any = None

    def arguments(self) -> list[str]:
        return self.selectors.split("=") if self.selectors else []


@dataclass(frozen=True)
class FlatSpec:
    name: str
    fields: tuple[FlatField, ...] = field(default_factory=tuple)

    @classmethod
    def from_mapping(cls, name: str, spec: Mapping[str, Mapping[str, Any]]) -> "FlatSpec":
        fields = []
        for out, item in spec.items():
            if "name" not in item:
                raise SpecError(f"flat spec {name!r}: field {out!r} has no path")
            function = item.get("transformation") or {}
            fields.append(
                FlatField(out, item["name"], function.get("function"), function.get("selectors"), item.get("defaultValue"))
            )
        return cls(name, tuple(fields))

    @classmethod
    def from_json(cls, name: str, text: str) -> "FlatSpec":
        return cls.from_mapping(name, json.loads(text))

    def to_mapping(self) -> dict[str, dict[str, Any]]:
        spec: dict[str, dict[str, Any]] = {}
        for item in self.fields:
            function = None
            if item.function:
                function = {"function": item.function}
                if item.selectors:
                    function["selectors"] = item.selectors
            spec[item.out] = {"name": item.path, "transformation": function, "defaultValue": item.default}
        return spec


class FlatSpecRegistry:
    """Specs by name: added one by one, or every ``*.json`` of a folder under its file stem."""

    def __init__(self, specs: Iterable[FlatSpec] = ()) -> None:
        self._specs = {spec.name: spec for spec in specs}

    def add(self, spec: FlatSpec) -> None:
        self._specs[spec.name] = spec

    def load_folder(self, folder: str | Path) -> None:
        for path in sorted(Path(folder).rglob("*.json")):
            self.add(FlatSpec.from_json(path.stem, path.read_text("utf-8")))

    def get(self, name: str) -> FlatSpec:
        try:
            return self._specs[name]
        except KeyError:
            raise SpecError(f"no flat spec named {name!r}") from None

    def names(self) -> list[str]:
        return sorted(self._specs)


def _with_default(value: Column, item: FlatField, leaf: T.DataType | None, mode: str) -> Column:
    if mode not in ("always", "function_only"):
        raise SpecError("defaults must be 'always' or 'function_only'")
    if item.default is None or (mode == "function_only" and item.function is None):
        return value
    default = F.lit(item.default)
    # A default the column's type cannot hold leaves the value unset.
    return F.coalesce(value, default if leaf is None else default.try_cast(leaf))


LOOKUP = "searchCoecsInArray"


def _lookups(schema: T.StructType, spec: FlatSpec, root: Column | None) -> dict[tuple[str, str], Column]:
    """(array's path, field) -> the field of all its entries, for the arrays that entries are looked up in by name."""
    arrays: dict[tuple[str, str], Column] = {}
    for item in spec.fields:
        if item.function == LOOKUP:
            items = struct_path(schema, item.path, root, unset="null")
            for field in ("name", item.arguments()[1]):
                arrays.setdefault((item.path, field), items.getField(field))
    return arrays


def struct_columns(
    schema: T.StructType,
    spec: FlatSpec,
    root: Column | None = None,
    defaults: str = "always",
    unset: str = "type_default",
    functions: FunctionRegistry | None = None,
    arrays: Mapping[tuple[str, str], Column] | None = None,
) -> list[Column]:
    """The flat columns over a nested struct. Paths are checked against ``schema`` before anything runs.

    ``defaults='function_only'`` applies a default only where a function gave null. ``arrays`` are columns that hold
    what the standard lookup by name reads, by (path, field).
    """
    functions, arrays = functions or default_registry(), arrays or {}
    columns = []
    for item in spec.fields:
        if item.function == LOOKUP and (item.path, "name") in arrays:
            name, field = item.arguments()
            value = pick_by_name(arrays[item.path, "name"], arrays[item.path, field], name)
            value = _with_default(value, item, None, defaults)
        elif item.function:
            value = struct_path(schema, item.path, root, unset="null")
            value = functions.get(item.function)(value, *item.arguments())
            value = _with_default(value, item, None, defaults)
        else:
            # A default of the spec must be able to see that the value is unset.
            keep_null = unset == "null" or (defaults == "always" and item.default is not None)
            value = struct_path(schema, item.path, root, unset="null" if keep_null else unset)
            value = _with_default(value, item, resolve_type(schema, item.path), defaults)
        columns.append(value.alias(item.out))
    return columns


_JSON_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def json_columns(
    variant: Column,
    spec: FlatSpec,
    types: Mapping[str, str] | None = None,
    defaults: str = "always",
    scalar_passthrough: bool = False,
    functions: FunctionRegistry | None = None,
) -> list[Column]:
    """The flat columns over parsed JSON. A column's type is ``types[out]``, else that of its default, else text."""
    functions, types = functions or default_registry(), types or {}
    columns = []
    for item in spec.fields:
        target = types.get(item.out) or _JSON_TYPES.get(type(item.default), "string")
        if item.function == LOOKUP:
            # The array is read with just the two fields the lookup needs.
            shape = f"array<struct<name:string,{item.arguments()[1]}:double>>"
            value = functions.get(item.function)(variant_path(variant, item.path, shape), *item.arguments())
        elif item.function == "arrayIdsFlatten":
            value = functions.get(item.function)(variant_path(variant, item.path, "array<string>"))
        else:
            value = variant_path(variant, item.path, target, scalar_passthrough)
            if item.function:
                value = functions.get(item.function)(value, *item.arguments())
        columns.append(_with_default(value, item, None, defaults).alias(item.out))
    return columns


def flatten(df: DataFrame, spec: FlatSpec, column: str | None = None, keep: Iterable[str] = (), **options: Any) -> DataFrame:
    """``df`` as flat columns: from its own columns, or from the struct or variant ``column``."""
    if column is not None and isinstance(df.schema[column].dataType, T.VariantType):
        return df.select(*keep, *json_columns(F.col(column), spec, **options))
    schema = df.schema if column is None else df.schema[column].dataType
    if not isinstance(schema, T.StructType):
        raise SpecError(f"{column!r} is neither a struct nor a variant")
    root = None if column is None else F.col(column)
    found = _lookups(schema, spec, root) if options.get("functions") is None else {}
    # Dozens of names are looked up in one array, so its names and fields are taken out once, in a projection of their own.
    names = {key: f"_lookup_{i}" for i, key in enumerate(found)}
    ready = df.withColumns({names[key]: value for key, value in found.items()}) if found else df
    arrays = {key: F.col(name) for key, name in names.items()}
    return ready.select(*keep, *struct_columns(schema, spec, root, arrays=arrays, **options))


def flat_json(columns: Iterable[Column]) -> Column:
    """Flat columns as one JSON text; nulls are written, 64-bit integers are numbers."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
