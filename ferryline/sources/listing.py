"""Listings that leave nothing out, and the contents of what was listed.

Spark's file index passes over names that begin with ``_`` or ``.`` and files of zero bytes. Here Spark tasks list the
folders themselves, level by level: the folders of a level are spread over tasks, what they hold is written as a table,
and its folders are the next level. The driver sees counts only. One folder is listed by one task.

Left out are folders that this package's file sinks write unfinished files to. Paths are plain, without patterns; those
without a scheme are local, as in the sinks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.errors import SpecError
from ferryline.session import materialise
from ferryline.sinks.files import open_filesystem

ATTEMPTS = "_attempts-"
MAX_TASKS = 4096
ROWS_A_BATCH = 8192
BYTES_A_TASK = 64 << 20
ENTRY_SCHEMA = "key string, name string, modified_ms long, size long, folder boolean"
_ENTRY = pa.schema([("key", pa.string()), ("name", pa.string()), ("modified_ms", pa.int64()), ("size", pa.int64()), ("folder", pa.bool_())])


def _scheme(path: str, inner: str) -> str:
    """What stands before a file system's own paths in the keys of a listing."""
    if not path.endswith(inner):
        raise SpecError(f"path {path} cannot be listed: it has options behind its name")
    return path[: len(path) - len(inner)] or "file:"


def _entries(scheme: str, infos: list[pafs.FileInfo]) -> Iterator[pa.RecordBatch]:
    kept = [i for i in infos if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
    kept = [i for i in kept if i.type == pafs.FileType.File or not i.base_name.startswith(ATTEMPTS)]
    for at in range(0, len(kept), ROWS_A_BATCH):
        some = kept[at : at + ROWS_A_BATCH]
        columns = [
            [scheme + i.path for i in some], [i.base_name for i in some], [None if i.mtime_ns is None else i.mtime_ns // 1_000_000 for i in some],
            [i.size if i.type == pafs.FileType.File else None for i in some], [i.type == pafs.FileType.Directory for i in some],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ENTRY.types, strict=True)], schema=_ENTRY)


def _inside(scheme: str):
    """What lies right in each folder. A folder that has gone meanwhile holds nothing."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                filesystem, path = open_filesystem(key)
                yield from _entries(scheme, filesystem.get_file_info(pafs.FileSelector(path, allow_not_found=True)))

    return inside


def every_file(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(key, name, modified_ms, size) of every file below ``path``, or of the file at ``path``; a missing path is an error."""
    bare = path.rstrip("/") or "/"
    if "://" not in bare and not bare.startswith("file:"):
        bare = os.path.abspath(bare)
    filesystem, inner = open_filesystem(bare)
    found, scheme = filesystem.get_file_info(inner), _scheme(bare, inner)
    if found.type == pafs.FileType.NotFound:
        raise SpecError(f"path {path} does not exist")
    if found.type == pafs.FileType.File:
        row = next(_entries(scheme, [found])).to_pylist()[0]
        return spark.createDataFrame([tuple(row.values())], ENTRY_SCHEMA).drop("folder")
    folders, count, levels = spark.createDataFrame([(scheme + inner,)], "key string"), 1, []
    while count:
        tasks = min(count, MAX_TASKS)
        levels.append(materialise(folders.repartition(tasks).mapInArrow(_inside(scheme), ENTRY_SCHEMA), "listing"))
        folders = levels[-1].filter("folder").select("key")
        count = folders.count() if recursive else 0
    return reduce(DataFrame.unionByName, (level.filter("not folder").drop("folder") for level in levels))


def read_listed(listing: DataFrame) -> DataFrame:
    """Whole objects of a listing: (key, content). A task has about ``BYTES_A_TASK`` and holds one object at a time.

    A key that the listing has twice is read twice; an object that has gone since is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                filesystem, path = open_filesystem(key)
                with filesystem.open_input_stream(path) as stream:
                    content = stream.read()
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([content], pa.binary())], ["key", "content"])

    size = listing.agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).head()
    tasks = max(1, min(size["files"], -(-(size["bytes"] or 0) // BYTES_A_TASK), 100 * MAX_TASKS))
    return listing.select("key").repartition(tasks).mapInArrow(read, "key string, content binary")
