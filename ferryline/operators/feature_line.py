"""Feature lines for linear learners, as one concat expression per config."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.errors import SpecError
from ferryline.functions.paths import struct_path, variant_path
from ferryline.functions.scalars import FunctionRegistry, default_registry

# Kinds of feature and kinds of record.
BINARY, NON_BINARY, AUTO_FILLED, PREDICT_VALUE = "BINARY", "NON_BINARY", "AUTO_FILLED", "PREDICT_VALUE"
KINDS = (BINARY, NON_BINARY, AUTO_FILLED, PREDICT_VALUE)
RECORD_KINDS = ("PROTO", "HASHMAP")


@dataclass(frozen=True)
class Feature:
    path: str
    name: str = ""
    namespace: str = ""
    kind: str = NON_BINARY
    function: str | None = None
    others: tuple["Feature", ...] = ()

    @classmethod
    def from_mapping(cls, item: Mapping[str, Any]) -> "Feature":
        kind = item.get("featureType") or NON_BINARY
        if kind not in KINDS:
            raise SpecError(f"unknown feature type {kind!r}")
        function = item.get("transformation") or {}
        return cls(
            path=item["featureInProto"],
            name=item.get("featureName") or "",
            namespace=item.get("namespace") or "",
            kind=kind,
            function=function.get("function"),
            others=tuple(cls.from_mapping(o) for o in function.get("others") or ()),
        )


@dataclass(frozen=True)
class FeatureConfig:
    features: tuple[Feature, ...]
    record: str = "PROTO"

    @classmethod
    def from_json(cls, text: str) -> "FeatureConfig":
        config = json.loads(text)
        record = config.get("type") or "PROTO"
        if record not in RECORD_KINDS:
            raise SpecError(f"unknown record type {record!r}")
        return cls(tuple(map(Feature.from_mapping, config["features"])), record)


def _line(
    config: FeatureConfig,
    read: Callable[[Feature], Column],
    space_before_bar: bool,
    functions: FunctionRegistry | None,
) -> Column:
    functions = functions or default_registry()
    pieces: list[Column] = []
    literal = ""
    namespace: str | None = None
    for feature in config.features:
        value = read(feature)
        if feature.function:
            value = functions.get(feature.function)(value, *[read(other) for other in feature.others])
        missing = F.raise_error(F.lit(f"feature {feature.name or feature.path!r} has no value"))
        text = F.coalesce(value.cast("string"), missing.cast("string"))
        # Where namespaces change is known from the config alone, so the line's frame is literal text.
        if feature.kind in (BINARY, NON_BINARY):
            if feature.namespace != namespace:
                bar = " |" if space_before_bar and (pieces or literal) else "|"
                literal += bar + feature.namespace
                namespace = feature.namespace
            literal += " "
        elif feature.kind == AUTO_FILLED:
            literal += " "
        literal += feature.name + (":" if feature.kind == NON_BINARY else "")
        pieces += [F.lit(literal), text]
        literal = ":1.0" if feature.kind == BINARY else ""
    return F.concat(*pieces, F.lit(literal))


def struct_line(
    schema: T.StructType,
    config: FeatureConfig,
    root: Column | None = None,
    space_before_bar: bool = False,
    functions: FunctionRegistry | None = None,
) -> Column:
    """The feature line of a nested struct. A feature without a value is an error.

    By default no space precedes the ``|`` of a namespace; ``space_before_bar`` adds it, which learners that
    follow the usual format need.
    """
    return _line(config, lambda f: struct_path(schema, f.path, root), space_before_bar, functions)


def json_line(
    variant: Column,
    config: FeatureConfig,
    types: Mapping[str, str] | None = None,
    space_before_bar: bool = False,
    functions: FunctionRegistry | None = None,
) -> Column:
    """The feature line of parsed JSON; ``types`` names the type of a path that feeds a function."""
    types = types or {}
    return _line(config, lambda f: variant_path(variant, f.path, types.get(f.path, "string")), space_before_bar, functions)
