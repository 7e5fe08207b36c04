"""Dotted paths such as ``a.b.[0].c`` into structs and into JSON."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.errors import SpecError

_INDEX = re.compile(r"\[(\d+)\]")

Step = str | int


def parse_path(path: str) -> list[Step]:
    """``a.[0].b`` and ``a[0].b`` both give ['a', 0, 'b']."""
    steps: list[Step] = []
    for piece in path.split("."):
        name = _INDEX.sub("", piece)
        if name:
            steps.append(name)
        steps.extend(int(i) for i in _INDEX.findall(piece))
    if not steps:
        raise SpecError(f"empty path {path!r}")
    return steps


def type_default(data_type: T.DataType) -> Column | None:
    """What an unset scalar reads as: 0, empty text, false; None for types without such a value."""
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        zero = F.lit(False) if isinstance(data_type, T.BooleanType) else F.lit(0)
        return zero.cast(data_type)
    if isinstance(data_type, T.StringType):
        return F.lit("")
    if isinstance(data_type, T.BinaryType):
        return F.lit(b"")
    if isinstance(data_type, T.ArrayType):
        return F.array().cast(data_type)
    return None


def resolve_type(schema: T.DataType, path: str) -> T.DataType:
    """The type at ``path``; an unknown field or a path ending on a sub-message is refused here."""
    at = schema
    for step in parse_path(path):
        if isinstance(step, int):
            if not isinstance(at, T.ArrayType):
                raise SpecError(f"{path!r}: [{step}] is applied to {at.simpleString()}")
            at = at.elementType
        elif isinstance(at, T.StructType) and step in at.names:
            at = at[step].dataType
        else:
            raise SpecError(f"{path!r}: no field {step!r} in {at.simpleString()}")
    if isinstance(at, T.StructType):
        raise SpecError(f"{path!r} ends on a sub-message, name one of its fields")
    return at


def struct_path(
    schema: T.StructType,
    path: str,
    root: Column | None = None,
    unset: str = "type_default",
    strict_index: bool = False,
) -> Column:
    """The value at ``path`` of a row (or of ``root``) with ``schema``.

    ``unset='type_default'`` reads unset values as 0, '' or false, ``'null'`` keeps them null. An index past
    the end is null in either case, or an error with ``strict_index``.
    """
    leaf = resolve_type(schema, path)
    value, there = root, F.lit(True)
    for step in parse_path(path):
        if isinstance(step, int):
            there = there if strict_index else there & (F.coalesce(F.size(value), F.lit(0)) > step)
            value = F.element_at(value, step + 1) if strict_index else F.get(value, step)
        else:
            value = F.col(f"`{step}`") if value is None else value.getField(step)
    default = type_default(leaf) if unset == "type_default" else None
    if default is None:
        return value
    # Only an unset field has a default; there is none for an element that is not there.
    indexed = any(isinstance(step, int) for step in parse_path(path))
    return F.when(there, F.coalesce(value, default)) if indexed else F.coalesce(value, default)


def json_path(steps: Sequence[Step]) -> str:
    """The steps as a variant path."""
    text = "$"
    for step in steps:
        text += f"[{step}]" if isinstance(step, int) else "['" + step.replace("'", "\\'") + "']"
    return text


def variant_path(variant: Column, path: str, target: str = "string", scalar_passthrough: bool = False) -> Column:
    """The value at ``path`` of parsed JSON, as ``target``; null when a step is missing.

    With ``scalar_passthrough`` a step applied to a scalar returns that scalar unchanged, so ``a.b`` on
    ``{"a": 1}`` gives 1.
    """
    steps = parse_path(path)
    value = F.try_variant_get(variant, json_path(steps), target)
    if not scalar_passthrough:
        return value
    for used in range(len(steps) - 1, 0, -1):
        prefix = F.try_variant_get(variant, json_path(steps[:used]), "variant")
        kind = F.schema_of_variant(prefix)
        scalar = ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        value = F.coalesce(value, F.when(scalar, prefix.try_cast(target)))
    return value


def string_value(value: Column) -> Column:
    """The text of a value; null is an error."""
    return F.coalesce(value.cast("string"), F.raise_error(F.lit("no value to take the text of")).cast("string"))
