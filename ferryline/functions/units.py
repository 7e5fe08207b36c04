"""Size and duration texts, as column functions and for options read on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferryline.errors import SpecError

LONG_MAX = 2**63 - 1

# Unit letters (powers of 1024), and units of time with their length in nanoseconds.
SIZE_PATTERN = r"([0-9]+)\s*(?:([KkMmGgTt])(?:[Bb]|i[Bb])|[Bb])"
SIZE_LETTERS = "kmgt"
SIZE_SUFFIXES = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}
DURATION_UNITS = [
    (r"d(?:ays?)?", 86_400_000_000_000),
    (r"h(?:ours?)?", 3_600_000_000_000),
    (r"m(?:in(?:utes?)?)?", 60_000_000_000),
    (r"s(?:ec(?:onds?)?)?", 1_000_000_000),
    (r"m(?:ill?i)?s(?:ec(?:onds?)?)?", 1_000_000),
    (r"(?:u|micro)s(?:ec(?:onds?)?)?", 1_000),
    (r"n(?:ano)?s(?:ec(?:onds?)?)?", 1),
]


def parse_size(text: Column, strict: bool = True) -> Column:
    """Bytes of a text such as ``150 mb``. Bad text and overflow raise, or give null when not ``strict``."""
    trimmed = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    digits = F.regexp_extract(trimmed, f"^{SIZE_PATTERN}$", 1)
    letter = F.lower(F.regexp_extract(trimmed, f"^{SIZE_PATTERN}$", 2))
    factor = F.lit(1).cast("bigint")
    for power, unit in enumerate(SIZE_LETTERS, start=1):
        factor = F.when(letter == unit, F.lit(1 << (10 * power)).cast("bigint")).otherwise(factor)
    # Leading zeros are legal; 19 significant digits are the most a long can hold.
    significant = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    wide = F.when((digits != "") & (F.length(significant) <= 19), significant.cast("decimal(38,0)"))
    total = wide * factor.cast("decimal(13,0)")
    amount = F.when(total <= F.lit(str(LONG_MAX)).cast("decimal(19,0)"), total.cast("bigint"))
    if not strict:
        return amount
    problem = F.concat(F.lit("not a valid data size: "), F.coalesce(text, F.lit("null")))
    return F.coalesce(amount, F.raise_error(problem).cast("bigint"))


def to_unit(size_bytes: Column, suffix: str) -> Column:
    """Whole units in a size, rounded down."""
    if suffix not in SIZE_SUFFIXES:
        raise SpecError(f"unknown data unit suffix {suffix!r}")
    # An arithmetic shift is a floor division that stays exact past 2^53.
    return F.shiftright(size_bytes.cast("bigint"), 10 * SIZE_SUFFIXES[suffix])


def format_size(size_bytes: Column, suffix: str = "B") -> Column:
    """``{n}{unit}``, rounded down."""
    return F.concat(to_unit(size_bytes, suffix).cast("string"), F.lit(suffix))


def parse_duration(text: Column, strict: bool = True) -> Column:
    """Nanoseconds of a text such as ``10 min``; empty and null give null, bad text raises."""
    nanos = F.lit(None).cast("bigint")
    for unit, length in reversed(DURATION_UNITS):
        digits = F.regexp_extract(text, rf"^([0-9]+)\s*{unit}$", 1)
        amount = F.when(F.length(digits) <= 19, digits.cast("decimal(19,0)") * F.lit(length).cast("decimal(15,0)"))
        fits = F.when(amount <= F.lit(str(LONG_MAX)).cast("decimal(19,0)"), amount.cast("bigint"))
        nanos = F.when(digits != "", fits).otherwise(nanos)
    if not strict:
        return nanos
    problem = F.concat(F.lit("duration could not be resolved: "), text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("bigint")).otherwise(
        F.coalesce(nanos, F.raise_error(problem).cast("bigint"))
    )


def size_option(text: str) -> int:
    """``parse_size`` for one option on the driver."""
    found = re.fullmatch(SIZE_PATTERN, text.strip("".join(map(chr, range(33)))), re.ASCII)
    if not found:
        raise SpecError(f"{text!r} is not a valid data size")
    letter = (found.group(2) or "").lower()
    size = int(found.group(1)) << (10 * (SIZE_LETTERS.index(letter) + 1 if letter else 0))
    if size > LONG_MAX:
        raise SpecError(f"{text!r} is too large")
    return size


def duration_option(text: str | None) -> int | None:
    """``parse_duration`` for one option on the driver."""
    if not text:
        return None
    for unit, length in DURATION_UNITS:
        found = re.fullmatch(rf"([0-9]+)\s*{unit}", text, re.ASCII)
        if found:
            return int(found.group(1)) * length
    raise SpecError(f"duration {text!r} could not be resolved")
