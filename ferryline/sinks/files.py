"""File sinks: one file per (worker, segment), named by job, worker and running number.

``SegmentedFiles`` is a Spark data source writer with two kinds of input:

* rows placed in units of whole files by ``place_units``, where worker and order are given;
* plain content rows, where each task is a worker. Nothing is shuffled, and Spark's input splitting keeps the
  workers even.

Either way the writer cuts the files while rows stream past.

Each task writes its files under names of its own attempt, and the driver moves the files of the attempts
Spark committed to their final names. A retried or duplicated task therefore leaves no half file.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ferryline.errors import SpecError
from ferryline.functions.units import size_option
from ferryline.operators.segment import (
    NO_LIMIT,
    SIZE_COLUMN,
    UNIT_COLUMNS,
    cut_batch,
    json_element_cost,
    place_units,
)
from ferryline.session import intermediates_dropped

# The frame of a JSON array file.
ARRAY_OPEN, ARRAY_BETWEEN, ARRAY_CLOSE = b"[\n", b",\n", b"\n]"

MOVE_THREADS = 32
# Parquet rows are buffered up to this many before a row group is written.
ROW_GROUP_ROWS = 100_000


@dataclass
class WrittenFiles(WriterCommitMessage):
    """(temporary path, final path) of each file a task wrote."""

    files: list[tuple[str, str]]


def open_filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a path or URI (local, hdfs, s3, ...), and the path within it."""
    uri = uri.replace("s3a://", "s3://", 1)
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class _JsonArrayFile:
    def __init__(self, stream: pa.NativeFile) -> None:
        self._stream, self._empty = stream, True
        stream.write(ARRAY_OPEN)

    def write(self, values: pa.RecordBatch) -> None:
        if values.column(0).null_count:
            raise ValueError("a null value cannot be an element of a JSON array file; leave such rows out before")
        # White space between tokens may be a line break; with none each element has a line of its own.
        lines = (t.replace("\n", " ").replace("\r", " ") for t in values.column(0).cast(pa.large_string()).to_pylist())
        body = ARRAY_BETWEEN.join(line.encode("utf-8") for line in lines)
        self._stream.write(body if self._empty else ARRAY_BETWEEN + body)
        self._empty = False

    def close(self) -> None:
        self._stream.write(ARRAY_CLOSE)
        self._stream.close()


class _ParquetFile:
    def __init__(self, stream: pa.NativeFile, schema: pa.Schema) -> None:
        self._stream, self._schema = stream, schema
        self._writer = pq.ParquetWriter(stream, schema)
        self._held: list[pa.RecordBatch] = []

    def write(self, values: pa.RecordBatch) -> None:
        self._held.append(values)
        if sum(b.num_rows for b in self._held) >= ROW_GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            self._writer.write_table(pa.Table.from_batches(self._held, self._schema))
            self._held = []

    def close(self) -> None:
        self._flush()
        self._writer.close()
        self._stream.close()


class _Staged(DataSourceArrowWriter):
    """Files are written below a folder of the run and get their names once Spark has committed all tasks."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.attempt_root = f"{self.root}/_attempts-{uuid.uuid4().hex}"

    def _make_room(self, filesystem: pafs.FileSystem) -> None:
        """What has to go before the files get their names; nothing by default."""

    def commit(self, messages: list[WrittenFiles | None]) -> None:
        filesystem, attempt_root = open_filesystem(self.attempt_root)
        moves = [(held, open_filesystem(final)[1]) for m in messages if m is not None for held, final in m.files]
        self._make_room(filesystem)
        with ThreadPoolExecutor(MOVE_THREADS) as pool:
            taken = list(pool.map(lambda move: _exists(filesystem, move[1]), moves))
            if any(taken):
                filesystem.delete_dir(attempt_root)
                raise FileExistsError(f"{moves[taken.index(True)][1]} exists already")
            for folder in sorted({posixpath.dirname(final) for _, final in moves}):
                filesystem.create_dir(folder, recursive=True)
            list(pool.map(lambda move: filesystem.move(*move), moves))
        if filesystem.get_file_info(attempt_root).type == pafs.FileType.Directory:
            filesystem.delete_dir(attempt_root)

    def abort(self, messages: list[WrittenFiles | None]) -> None:
        filesystem, attempt_root = open_filesystem(self.attempt_root)
        if filesystem.get_file_info(attempt_root).type == pafs.FileType.Directory:
            filesystem.delete_dir(attempt_root)


class SegmentedFilesWriter(_Staged):
    """Options: path, job, format (json or parquet), layout (job, flat or object), max_bytes, max_count."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options["path"])
        self.job = options["job"]
        self.format = options.get("format", "json")
        self.layout = options.get("layout", "job")
        self.max_bytes = int(options.get("max_bytes") or NO_LIMIT)
        self.max_count = int(options.get("max_count") or NO_LIMIT)
        self.replace = options.get("replace") == "true"
        self.placed = tuple(schema.names[: len(UNIT_COLUMNS)]) == UNIT_COLUMNS
        if self.format not in ("json", "parquet"):
            raise SpecError(f"unknown file format {self.format!r}")
        if self.layout not in ("job", "flat", "object"):
            raise SpecError(f"unknown layout {self.layout!r}")
        if self.max_bytes < 1 or self.max_count < 1:
            raise SpecError("limits must be positive")
        content = self._content(schema.names)
        if not content or (self.format == "json" and len(content) != 1):
            raise SpecError("a JSON array file takes one text column, a Parquet file at least one column")

    def _final_name(self, worker: int, segment: int) -> str:
        name = f"{self.job}-{worker}-{segment}"
        if self.layout == "object":
            return f"{self.root}/{name}"
        if self.layout == "flat":
            return f"{self.root}/{name}.{self.format}"
        return f"{self.root}/{self.job}/sink/{worker}/{name}.{self.format}"

    def _open(self, filesystem: pafs.FileSystem, path: str, schema: pa.Schema):
        stream = filesystem.open_output_stream(path)
        return _JsonArrayFile(stream) if self.format == "json" else _ParquetFile(stream, schema)

    def _content(self, names: list[str]) -> list[str]:
        return [n for n in names if n != SIZE_COLUMN and not (self.placed and n in UNIT_COLUMNS)]

    def _pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        """Stretches of rows that belong to one file, in order."""
        task, at, state = TaskContext.get().partitionId(), None, (0, 0, 0)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            content, cost = batch.select(self._content(batch.schema.names)), self._cost(batch)
            for worker, unit, first, low, high in self._units(batch, task):
                if (worker, unit) != at:
                    at, state = (worker, unit), (first, 0, 0)
                segment, *rest = cut_batch(cost[low:high], *state, self.max_bytes, self.max_count)
                state = tuple(rest)
                edges = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), high - low]
                for start, stop in zip(edges[:-1], edges[1:]):
                    yield (worker, int(segment[start])), content.slice(low + start, stop - start)

    def _units(self, batch: pa.RecordBatch, task: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(worker, unit, first file, from, to) of the batch's stretches; without placement it is one stretch."""
        if not self.placed:
            yield task, 0, 0, 0, batch.num_rows
            return
        worker, unit, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        changes = np.flatnonzero((worker[1:] != worker[:-1]) | (unit[1:] != unit[:-1])) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:]):
            yield int(worker[low]), int(unit[low]), int(first[low]), low, high

    def _cost(self, batch: pa.RecordBatch) -> np.ndarray:
        if SIZE_COLUMN in batch.schema.names:
            sizes = batch.column(batch.schema.get_field_index(SIZE_COLUMN))
        elif self.format == "json":
            sizes = pc.add(pc.fill_null(pc.cast(pc.binary_length(batch.column(0)), pa.int64()), 0), 2)
        else:
            return np.ones(batch.num_rows, np.int64)
        return sizes.to_numpy(zero_copy_only=False).astype(np.int64)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        filesystem, attempt_root = open_filesystem(self.attempt_root)
        folder = f"{attempt_root}/{uuid.uuid4().hex}"
        files: list[tuple[str, str]] = []
        current, out = None, None
        for here, rows in self._pieces(iterator):
            if here != current:
                if out is None:
                    filesystem.create_dir(folder, recursive=True)
                else:
                    out.close()
                held = f"{folder}/{here[0]}-{here[1]}"
                out, current = self._open(filesystem, held, rows.schema), here
                files.append((held, self._final_name(*here)))
            out.write(rows)
        if out is not None:
            out.close()
        return WrittenFiles(files)

    def _make_room(self, filesystem: pafs.FileSystem) -> None:
        """With ``replace``, the job's files of an earlier run go."""
        if not self.replace:
            return
        own = re.compile(rf"{re.escape(self.job)}-\d+-\d+(\.{self.format})?")
        selector = pafs.FileSelector(open_filesystem(self.root)[1], recursive=self.layout == "job", allow_not_found=True)
        for info in filesystem.get_file_info(selector):
            if info.type == pafs.FileType.File and own.fullmatch(info.base_name) and self.attempt_root not in info.path:
                filesystem.delete_file(info.path)


def _exists(filesystem: pafs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type != pafs.FileType.NotFound


class SegmentedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segmented_files"

    def writer(self, schema: StructType, overwrite: bool) -> SegmentedFilesWriter:
        return SegmentedFilesWriter(dict(self.options), schema)


def _save(
    rows: DataFrame,
    path: str,
    job: str,
    file_format: str,
    layout: str,
    max_bytes: int | str | None,
    max_count: int | None,
    replace: bool = False,
) -> None:
    rows.sparkSession.dataSource.register(SegmentedFiles)
    options: dict[str, str | int] = {"path": path, "job": job, "format": file_format, "layout": layout}
    if max_bytes is not None:
        options["max_bytes"] = size_option(max_bytes) if isinstance(max_bytes, str) else max_bytes
    if max_count is not None:
        options["max_count"] = max_count
    if replace:
        options["replace"] = "true"
    rows.write.format("segmented_files").mode("append").options(**options).save()


def write_as_they_come(
    rows: DataFrame,
    path: str,
    job: str,
    file_format: str = "json",
    max_bytes: int | str | None = None,
    max_count: int | None = None,
    layout: str = "flat",
    replace: bool = False,
) -> None:
    """Write content rows with each task as a worker that cuts its own files; no shuffle.

    A column named ``_size`` gives the bytes of a row and is not written; JSON texts are measured as they are.
    A file that exists already is an error, or with ``replace`` all of the job's own files give way.
    """
    _save(rows, path, job, file_format, layout, max_bytes, max_count, replace)


def write_json_arrays(
    rows: DataFrame,
    path: str,
    job: str,
    value: str = "value",
    worker: str = "worker",
    order: list[str] | None = None,
    max_bytes: int | str | None = None,
    max_count: int | None = None,
    layout: str = "job",
) -> None:
    """JSON texts as array files, cut by size or count, whichever is met first. No rows, no files.

    Worker and order are columns here, so the files do not depend on how Spark splits the input. Where that
    does not matter, ``write_as_they_come`` does without the shuffle.
    """
    order = order or ["seq"]
    narrow = rows.select(F.col(worker).alias("worker"), *order, F.col(value).alias("value"))
    with intermediates_dropped(rows.sparkSession):
        placed = place_units(narrow, "worker", order, json_element_cost(F.col("value")), max_bytes, max_count)
        content = placed.select(*UNIT_COLUMNS, SIZE_COLUMN, "value")
        _save(content, path, job, "json", layout, max_bytes, max_count)


def write_parquet_segments(
    rows: DataFrame,
    path: str,
    job: str,
    worker: str = "worker",
    order: list[str] | None = None,
    cost: str = "1",
    max_bytes: int | str | None = None,
    max_count: int | None = None,
    layout: str = "job",
) -> None:
    """Messages as Parquet files with exact names and cuts.

    A size limit works on ``cost``, an SQL expression for the bytes of one row, because the encoded size of a
    Parquet file is not known before it is closed. The worker and order columns are not written.
    """
    order = order or ["seq"]
    named = rows.withColumnRenamed(worker, "worker")
    with intermediates_dropped(rows.sparkSession):
        placed = place_units(named, "worker", order, F.expr(cost).cast("bigint"), max_bytes, max_count)
        _save(placed.drop("worker", *order), path, job, "parquet", layout, max_bytes, max_count)


def write_parquet(rows: DataFrame, path: str, max_count: int | None = None, mode: str = "errorifexists") -> None:
    """Messages as Parquet through Spark's own writer: no shuffle, Spark's file names.

    ``max_count`` cuts each task's output, so files hold at most that many rows.
    """
    writer = rows.write.mode(mode)
    if max_count is not None:
        writer = writer.option("maxRecordsPerFile", max_count)
    writer.parquet(path)


class _BytesWriter(_Staged):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFiles:
        filesystem, attempt_root = open_filesystem(self.attempt_root)
        folder = f"{attempt_root}/{uuid.uuid4().hex}"
        written: list[tuple[str, str]] = []
        for batch in iterator:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not written:
                    filesystem.create_dir(folder, recursive=True)
                held = f"{folder}/{len(written)}"
                with filesystem.open_output_stream(held) as stream:
                    stream.write(content)
                written.append((held, f"{self.root}/{key}"))
        return WrittenFiles(written)


class ObjectBytes(DataSource):
    """One object per row: (key, content)."""

    @classmethod
    def name(cls) -> str:
        return "object_bytes"

    def writer(self, schema: StructType, overwrite: bool) -> _BytesWriter:
        return _BytesWriter(dict(self.options))


def write_objects(rows: DataFrame, path: str, key: str = "key", content: str = "content") -> None:
    """Upload each row's bytes under its key. Objects show once all are written; a key that exists is an error."""
    rows.sparkSession.dataSource.register(ObjectBytes)
    picked = rows.select(F.col(key).alias("key"), F.col(content).alias("content"))
    picked.write.format("object_bytes").mode("append").options(path=path).save()
