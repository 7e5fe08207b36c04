"""Data types, platforms and which platform carries which type."""

from __future__ import annotations

from enum import Enum

from ferryline.errors import SpecError


class DataType(Enum):
    # The spellings a job description uses.
    LONG = "long"
    INTEGER = "int"
    STRING = "string"
    UUID = "uuid"
    JSON = "json"
    PROTOBUF = "protobuf"

    @classmethod
    def parse(cls, text: str) -> "DataType":
        try:
            return cls(text)
        except ValueError:
            raise SpecError(f"data type {text!r} is not supported") from None


class Platform(Enum):
    KAFKA = "KAFKA"
    S3 = "S3"
    HDFS = "HDFS"
    LOCAL_FS = "LOCAL_FS"

    @classmethod
    def parse(cls, text: str) -> "Platform":
        try:
            return cls(text.upper())
        except (ValueError, AttributeError):
            raise SpecError(f"platform {text!r} does not exist") from None


SOURCES = frozenset({Platform.KAFKA, Platform.S3, Platform.HDFS})
SINKS = frozenset(Platform)

FILE_TYPES = frozenset({DataType.PROTOBUF, DataType.JSON})


def carries(platform: Platform, data_type: DataType) -> bool:
    """A topic carries every type; files carry protobuf (as Parquet) and JSON (as array files)."""
    return platform is Platform.KAFKA or data_type in FILE_TYPES


def check_side(platform: Platform, data_type: DataType, side: str) -> None:
    """Raise unless ``platform`` can be the ``side`` ('source' or 'sink') of a job for ``data_type``."""
    if platform not in (SOURCES if side == "source" else SINKS):
        raise SpecError(f"platform {platform.name} has no {side} part")
    if not carries(platform, data_type):
        raise SpecError(f"{side} {platform.name} does not support data type {data_type.name}")
