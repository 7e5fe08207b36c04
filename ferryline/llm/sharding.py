"""Shards cut from a Hilbert curve over several dimensions of metadata.

Each dimension is quantised to ``bits`` bits, the cells are numbered along the Hilbert curve, rows are put in that
order and cut into runs of equal row counts (law ``rows``: counts differ by one at most). Neighbouring cells of the
curve are neighbours in every dimension, so each shard covers a narrow range of each and files can be skipped by any.

Values of a category get cells in their own order, spread by their rows: the cell tells how many of ``2 ** bits - 2``
evenly spaced marks of the rows lie before a value. A shard thus holds a range of values, which a file's least and
greatest value show. Marks are set by the ``MAX_VALUES`` most frequent values; others fall between them. That bears on
which rows are neighbours and not on the law.

No row order over the whole table is ever sorted: the curve has at most ``2 ** (bits * dimensions)`` cells, their row
counts give each cell its first position, and rows are numbered within their cell by groups (``positions``).

Defined cases: a null text has no bytes and the checksum of the empty text; a null source or language is a value of
its own; equal rows get positions of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.llm.positions import numbered
from ferryline.session import materialise

ROW_BYTES = 16
# Values of a category that its marks are set by.
MAX_VALUES = 4096


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of ``points`` (n by dimensions, values below ``2 ** bits``).

    Axes are turned into the transposed index by undoing, from the top bit down, the reflections and exchanges of
    each sub-cube, and Gray coding what is left; the index reads its bits across the dimensions.
    """
    x = np.array(points.T, np.int64)
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(dims):
            set_here = (x[axis] >> bit) & 1 == 1
            swap = np.where(set_here, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[axis] = x[axis] ^ swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> bit) & 1 == 1, flip ^ ((1 << bit) - 1), flip)
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(dims):
            index = (index << 1) | ((x[axis] >> bit) & 1)
    return index


def with_cell(df: DataFrame, dimensions: Sequence[Column], bits: int, name: str = "cell") -> DataFrame:
    """``df`` with the curve index of its quantised dimensions (values from 0 to ``2 ** bits - 1``)."""
    numbers = [f"_d{i}" for i in range(len(dimensions))]
    shown = df.withColumns({n: d.cast("int") for n, d in zip(numbers, dimensions, strict=True)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in numbers])
            kept = [n for n in batch.schema.names if n not in numbers]
            cells = pa.array(hilbert_index(points, bits))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), cells], [*kept, name])

    return shown.mapInArrow(index, df.drop(name).schema.add(name, "long"))


def marks(docs: DataFrame, column: str, bits: int) -> list[str]:
    """Values, in their order, at evenly spaced places of the rows with a value; fewer than ``2 ** bits - 1``."""
    value = F.col(column).cast("string").alias("value")
    counts = docs.select(value).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    # Of equally frequent values any may be left out, so they are taken by their hash and not by their order.
    shown = counts.orderBy(F.desc("n"), F.xxhash64("value"), "value").limit(MAX_VALUES).collect()
    # Spark orders texts by their bytes.
    values = sorted(((r["value"], r["n"]) for r in shown), key=lambda v: v[0].encode("utf-8", "surrogatepass"))
    upto = np.cumsum([n for _, n in values])
    places = (1 << bits) - 2
    return [values[int(np.searchsorted(upto, upto[-1] * k / (places + 1), side="right"))][0] for k in range(1, places + 1)] if values else []


def category(value: Column, own_marks: Sequence[str]) -> Column:
    """A value's cell: 1 and the number of marks before it; null has cell 0."""
    text = value.cast("string")
    cell = F.when(text.isNull(), 0)
    for number, mark in enumerate(own_marks):
        if number == 0 or mark != own_marks[number - 1]:
            cell = cell.when(text <= F.lit(mark), 1 + number)
    return cell.otherwise(1 + len(own_marks))


def magnitude(value: Column, bits: int) -> Column:
    """Cells of a positive number by quarter powers of two from 64 on."""
    return F.least(F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1))) * 4) - 24, F.lit(0)), F.lit((1 << bits) - 1))


def shard(docs: DataFrame, shards: int, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, source_cell, lang_cell, cell, shard and slot of each row.

    The dimensions are source, language and size. ``slot`` counts from 0 in each shard, in curve order.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        category(F.col("source"), marks(docs, "source", bits)).cast("int").alias("source_cell"),
        category(F.col("lang"), marks(docs, "lang", bits)).cast("int").alias("lang_cell"),
    )
    dimensions = [F.col("source_cell"), F.col("lang_cell"), magnitude(F.col("size"), bits)]
    placed = materialise(with_cell(rows, dimensions, bits), "cells")
    # At most 2 ** (3 * bits) rows, whatever the input.
    sizes = sorted((r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = placed.sparkSession.createDataFrame(
        [(cell, start) for (cell, _), start in zip(sizes, before, strict=False)], "cell long, cell_start long"
    )
    ranked = numbered(placed, "cell", ["doc_id", "text_crc32", "size"], total).join(F.broadcast(starts), "cell")
    position = F.col("cell_start") + F.col("rank")
    numbered_shard = F.expr(f"(_position * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("_position", position)
        .withColumn("shard", numbered_shard.cast("int"))
        .withColumn("slot", F.col("_position") - first)
        .select("doc_id", "size", "text_crc32", "source_cell", "lang_cell", "cell", "shard", "slot")
    )
