"""Scalar functions: feature arithmetic, time helpers, text helpers, URL parts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryline.errors import SpecError


def _or_zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def multiply_float(*values: Column) -> Column:
    """Product in double precision, null as 0, returned as float."""
    return reduce(lambda a, b: a * b, map(_or_zero, values), F.lit(1.0)).cast("float")


def sum_float(*values: Column) -> Column:
    """Sum in double precision, null as 0, returned as float."""
    return reduce(lambda a, b: a + b, map(_or_zero, values), F.lit(0.0)).cast("float")


def bool_to_int(value: Column) -> Column:
    """true is 1; false and null are 0."""
    return F.coalesce(value, F.lit(False)).cast("int")


def array_ids_flatten(values: Column) -> Column:
    """Elements joined by commas; a null array gives an empty string. Null elements are left out."""
    return F.coalesce(F.array_join(values.cast("array<string>"), ","), F.lit(""))


def hour_of_day(epoch_ms: Column) -> Column:
    """Hour (0-23, UTC) of an epoch in milliseconds, whatever the session time zone.

    The name of this function is all that is known of the original, so the definition is this package's own.
    """
    return (F.pmod(F.floor(epoch_ms / 3_600_000).cast("bigint"), F.lit(24))).cast("int")


def micros_to_timestamp(epoch_us: Column) -> Column:
    return F.timestamp_micros(epoch_us)


def same_second(first_ms: Column, second_ms: Column) -> Column:
    return F.floor(first_ms / 1000) == F.floor(second_ms / 1000)


def search_in_array(items: Column, name: str, field: str) -> Column:
    """``field`` of the first array element whose ``name`` field equals ``name``; null when there is none.

    Named by bundled flat specs but defined nowhere there, so the definition is this package's own.
    """
    return pick_by_name(items.getField("name"), items.getField(field), name)


def pick_by_name(names: Column, values: Column, name: str) -> Column:
    """The value at the place of the first equal name."""
    # By position rather than by a lambda: specs look up dozens of names per row, and this stays in codegen.
    return F.get(values, (F.array_position(names, name) - 1).cast("int"))


def join_nullable(delimiter: str, parts: Column) -> Column:
    """Array elements joined, skipping null and empty ones; a null array gives the text ``null``."""
    # array_join leaves nulls out by itself.
    return F.when(parts.isNull(), F.lit("null")).otherwise(F.array_join(F.array_remove(parts, ""), delimiter))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(text.rlike(r"^\p{javaWhitespace}*$"), F.lit(True))


def is_not_blank(text: Column) -> Column:
    return ~is_blank(text)


def _pair_key(pair: Column) -> Column:
    at = F.instr(pair, "=")
    return F.when(at > 1, F.substring(pair, F.lit(1), at - 1)).otherwise(pair)


def _pair_value(pair: Column) -> Column:
    at = F.instr(pair, "=")
    return F.when((at > 1) & (F.length(pair) > at), F.substring(pair, at + 1, F.length(pair)))


def query_pairs(url: Column, on_error: str = "fail") -> Column:
    """The query of ``url`` as an array of (key, value) in order; an empty array without a query.

    ``k=`` and ``k`` have a null value, and a leading ``=`` stays part of the key. Text that cannot be decoded is an
    error, or null with ``on_error="skip"``.
    """
    decoded = F.try_url_decode if on_error == "skip" else F.url_decode
    # The query ends at the fragment; taken by pattern because a strict URI parser refuses many real URLs.
    # Trailing separators give no pair.
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&+$", "")
    pairs = F.transform(
        F.split(query, "&", -1),
        lambda p: F.struct(
            decoded(_pair_key(p)).alias("key"), decoded(_pair_value(p)).alias("value")
        ),
    )
    return F.when(F.length(query) > 0, pairs).otherwise(F.slice(pairs, 1, 0))


def split_query(url: Column) -> Column:
    """The query of ``url`` as a map; the last of several equal keys wins."""

    def last_of_each(pairs: Column) -> Column:
        def is_last(pair: Column, at: Column) -> Column:
            later = F.slice(pairs, at + 2, F.size(pairs))
            return ~F.exists(later, lambda other: other["key"] == pair["key"])

        return F.map_from_entries(F.filter(pairs, is_last))

    # A lambda over a one-element array names the pairs, so the URL is taken apart once and not once per pair.
    return F.get(F.transform(F.array(query_pairs(url)), last_of_each), 0)


def strip_leading_slashes(path: Column) -> Column:
    return F.ltrim(path, F.lit("/"))


def strip_ending_slashes(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


class FunctionRegistry:
    """Functions flat specs and feature configs refer to by name.

    A function takes the path's column, then either the selector parts (flat specs) or further columns
    (feature configs), and returns a column. ``pandas_udf`` objects qualify.
    """

    def __init__(self) -> None:
        self._functions: dict[str, Callable[..., Column]] = {}

    def add(self, name: str, function: Callable[..., Column]) -> None:
        self._functions[name] = function

    def get(self, name: str) -> Callable[..., Column]:
        try:
            return self._functions[name]
        except KeyError:
            raise SpecError(f"function {name!r} is not registered") from None

    def names(self) -> Sequence[str]:
        return sorted(self._functions)


def default_registry() -> FunctionRegistry:
    registry = FunctionRegistry()
    # The names configs use.
    registry.add("multiplyFloat", multiply_float)
    registry.add("sumFloat", sum_float)
    registry.add("boolToInt", bool_to_int)
    registry.add("arrayIdsFlatten", array_ids_flatten)
    registry.add("fromTimestampToHourInDay", hour_of_day)
    registry.add("searchCoecsInArray", search_in_array)
    return registry
