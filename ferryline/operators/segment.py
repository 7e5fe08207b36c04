"""Cutting each worker's ordered elements into files by element count and by byte size.

After each element a file is full when it holds ``max_count`` elements or at least ``max_bytes`` bytes, so a
file may overshoot by one element. A JSON array file of n elements counts ``2 + sum(bytes) + 2 * (n - 1)``
bytes, which is the sum of ``bytes + 2`` over its elements.

The size rule is a running sum that restarts at every cut, so a cut depends on all cuts before it. A worker
that holds a third of the data still must not become one task, so the sum is taken apart:

1. every worker's elements are numbered (``with_ordinal``) and cut into chunks of equal length;
2. each chunk works out, on its own, what it does with any possible open file it may be handed: where that
   file would end and in which state the chunk then leaves the next file. Starting later never ends earlier,
   so this is a step function and only its steps are kept;
3. the functions of a worker's chunks are composed in a tree, and the open files handed down it (``chain``);
4. each chunk, now knowing the open file it was really handed, cuts its elements while they stream past.

All steps run in parallel over the chunks of all workers, and no task sees more than some of a worker's chunks. For writing, rows are placed in units that begin
where a file begins (``place_units``), so every file lies within one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferryline.errors import SpecError
from ferryline.functions.units import size_option
from ferryline.operators import chain
from ferryline.operators.chain import Steps
from ferryline.operators.ordinal import with_ordinal
from ferryline.session import checked_broadcast, materialise

# A chunk is worked out in memory from about ten bigints per element, so this bounds a task at some tens of MB.
CHUNK_ROWS = 250_000

# A limit that is not set is one no file can reach.
NO_LIMIT = 2**62

_START_SCHEMA = "_worker bigint, _chunk bigint, open_unit bigint, first_start bigint, first_segment bigint"

# Columns of rows placed for writing: worker, the unit within it, the unit's first file, an element's bytes.
UNIT_COLUMNS = ("_worker", "_unit", "_segment")
SIZE_COLUMN = "_size"


def json_element_cost(value: Column) -> Column:
    """What one element adds to the size of a JSON array file."""
    return F.octet_length(value).cast("bigint") + 2


def next_starts(cost: np.ndarray, max_bytes: int, max_count: int) -> tuple[np.ndarray, np.ndarray]:
    """For a file that starts at each position: where the next one starts, and whether this one fills up.

    ``cost`` is the chunk's element costs. A file that does not fill up within the chunk maps to its own
    start; position ``len(cost)`` stands for the start of the next chunk.
    """
    n = len(cost)
    ends = np.cumsum(cost)
    begins = ends - cost
    by_size = np.searchsorted(ends, begins + max_bytes, side="left") + 1
    by_count = np.arange(n, dtype=np.int64) + min(max_count, NO_LIMIT)
    start = np.minimum(by_size, by_count)
    fills = start <= n
    here = np.arange(n, dtype=np.int64)
    return np.append(np.where(fills, start, here), n), np.append(fills, False)


def chunk_steps(cost: np.ndarray, max_bytes: int, max_count: int) -> dict[str, object]:
    """What a chunk does with the open file handed to it, as the steps of a monotone function.

    Entry 0 is for no open file. The others are for files that end inside the chunk, by the position after
    their last element: entry ``i`` applies from ``from_cost``/``from_count`` on, that is when the elements
    before that position do not fill the file. ``closed`` counts the files that start and end in the chunk,
    ``left_cost``/``left_count`` describe the file left open.
    """
    n = len(cost)
    ends = np.cumsum(cost)
    start, fills = next_starts(cost, max_bytes, max_count)
    hop, closed = start.copy(), fills.astype(np.int64)
    while True:
        further = hop[hop]
        if np.array_equal(further, hop):
            break
        closed = closed + closed[hop]
        hop = further
    total = int(ends[-1])
    before = np.append(0, ends)
    left_cost, left_count = total - before[hop], n - hop

    # An open file takes at most as many elements as a fresh one, so entries past that cannot occur.
    last = int(start[0]) if fills[0] else n
    entries = np.arange(1, last + 1)
    # A step begins where the outcome differs from the entry before.
    outcome = np.stack([closed[entries], hop[entries]])
    changed = np.append(True, (outcome[:, 1:] != outcome[:, :-1]).any(axis=0))
    kept = entries[changed]
    picks = np.append(0, kept)
    return {
        "n": n,
        "cost": total,
        "from_cost": np.append(0, before[kept - 1]),
        "from_count": np.append(0, kept - 1),
        "closed": closed[picks],
        "left_cost": left_cost[picks],
        "left_count": left_count[picks],
    }


def step_through(steps: object, open_cost: int, open_count: int, max_bytes: int, max_count: int) -> tuple[int, int, int]:
    """(files closed, cost left open, count left open) of a chunk that was handed an open file."""
    if open_count == 0:
        at, handed = 0, 0
    elif open_cost + steps.cost < max_bytes and open_count + steps.n < max_count:
        return 0, open_cost + int(steps.cost), open_count + int(steps.n)
    else:
        from_cost, from_count = np.asarray(steps.from_cost)[1:], np.asarray(steps.from_count)[1:]
        reached = (open_cost + from_cost < max_bytes) & (open_count + from_count < max_count)
        at, handed = int(np.count_nonzero(reached)), 1
    return handed + int(steps.closed[at]), int(steps.left_cost[at]), int(steps.left_count[at])


def steps_of(cost: np.ndarray, chunk: int, max_bytes: int, max_count: int) -> Steps:
    """A chunk's function; the file it leaves open began in it, unless the file it was handed never ends there."""
    steps = chunk_steps(cost, max_bytes, max_count)
    return Steps(**steps, unit=np.full(len(steps["closed"]), chunk))


def cut_batch(
    cost: np.ndarray, segment: int, open_cost: int, open_count: int, max_bytes: int, max_count: int
) -> tuple[np.ndarray, int, int, int]:
    """Segment ids for consecutive elements, and the state after them. Loops over files, not over elements."""
    ids = np.empty(len(cost), np.int64)
    ends = np.cumsum(cost)
    at, before = 0, 0
    while at < len(cost):
        by_size = int(np.searchsorted(ends, before + max_bytes - open_cost, side="left")) + 1
        stop = min(by_size, at + max_count - open_count)
        if stop > len(cost):
            ids[at:] = segment
            return ids, segment, open_cost + int(ends[-1]) - before, open_count + len(cost) - at
        ids[at:stop] = segment
        segment, open_cost, open_count = segment + 1, 0, 0
        at, before = stop, int(ends[stop - 1])
    return ids, segment, open_cost, open_count


def first_start(cost: np.ndarray, open_cost: int, open_count: int, max_bytes: int, max_count: int) -> int:
    """Position of the first file start in a chunk that was handed an open file; its length if there is none."""
    if open_count == 0:
        return 0
    by_size = int(np.searchsorted(np.cumsum(cost), max_bytes - open_cost, side="left")) + 1
    return min(by_size, max_count - open_count, len(cost))


def _first_start_task(max_bytes: int, max_count: int):
    def task(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_ordinal")
        entry = rows.iloc[0]
        cost = rows[SIZE_COLUMN].to_numpy(np.int64)
        at = first_start(cost, int(entry.open_cost), int(entry.open_count), max_bytes, max_count)
        segment = int(entry.base_segment) + (1 if entry.open_count else 0)
        values = (*keys, int(entry.open_unit), int(entry._ordinal) + at, segment)
        return pd.DataFrame([values], columns=["_worker", "_chunk", "open_unit", "first_start", "first_segment"])

    return task


def _cut_task(max_bytes: int, max_count: int, schema: pa.Schema):
    """Tag elements while they stream past, sorted by (worker, chunk, ordinal); memory is one batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, (0, 0, 0)
        for batch in batches:
            if batch.num_rows == 0:
                continue

            def column(name: str) -> np.ndarray:
                return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

            worker, chunk, cost = column("_worker"), column("_chunk"), column(SIZE_COLUMN).astype(np.int64)
            changes = np.flatnonzero((worker[1:] != worker[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            edges = [0, *changes.tolist(), batch.num_rows]
            ids = np.empty(batch.num_rows, np.int64)
            for low, high in zip(edges[:-1], edges[1:]):
                here = (worker[low], chunk[low])
                if here != at:
                    at = here
                    state = tuple(int(column(c)[low]) for c in ("base_segment", "open_cost", "open_count"))
                ids[low:high], *rest = cut_batch(cost[low:high], *state, max_bytes, max_count)
                state = tuple(rest)
            names = [f.name for f in schema]
            arrays = [pa.array(ids) if n == names[-1] else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return task


def fixed_length(smallest: int | None, largest: int | None, max_bytes: int, max_count: int) -> int | None:
    """Elements per file if every file must get the same number, else None.

    That is so when the count is reached before even the largest elements fill a file, and when the smallest
    and the largest elements fill one after equally many. These are also the cases in which the steps of a
    chunk would be many, as its cuts never fall together.
    """
    if largest is None or smallest < 1:
        return None
    soonest, latest = -(-max_bytes // largest), -(-max_bytes // smallest)
    return min(max_count, soonest) if max_count <= soonest or soonest == latest else None


def by_count(df: DataFrame, worker: str, order: list[str], max_count: int, name: str = "segment_id") -> DataFrame:
    """Segments of exactly ``max_count`` elements per worker (the last may be shorter)."""
    if max_count < 1:
        raise SpecError("a file must hold at least one element")
    ranked = with_ordinal(df, order, [worker], "_ordinal")
    return ranked.withColumn(name, F.expr(f"_ordinal div {int(max_count)}L")).drop("_ordinal")


def _limits(max_bytes: int | str | None, max_count: int | None) -> tuple[int, int]:
    size = size_option(max_bytes) if isinstance(max_bytes, str) else max_bytes
    size, count = NO_LIMIT if size is None else size, NO_LIMIT if max_count is None else max_count
    if size < 1 or count < 1:
        raise SpecError("limits must be positive")
    return size, count


def _fixed(ranked: DataFrame, max_bytes: int, max_count: int) -> int | None:
    if max_bytes == NO_LIMIT:
        return max_count
    return fixed_length(*ranked.agg(F.min(SIZE_COLUMN), F.max(SIZE_COLUMN)).head(), max_bytes, max_count)


def _in_chunks(ranked: DataFrame, worker: str, chunk_rows: int) -> DataFrame:
    missing = F.raise_error(F.lit("an element has no worker")).cast("bigint")
    return ranked.withColumns(
        {
            "_worker": F.coalesce(F.col(worker).cast("bigint"), missing),
            "_chunk": F.expr(f"_ordinal div {int(chunk_rows)}L"),
        }
    )


def _last_chunk(ranked: DataFrame, chunk_rows: int) -> int:
    return (ranked.agg(F.max("_ordinal")).head()[0] or 0) // chunk_rows


def _entries(chunked: DataFrame, last_chunk: int, max_bytes: int, max_count: int) -> DataFrame:
    """One row per chunk: the open file it is handed. Written once, so later checks and joins read the same rows."""
    leaves = chain.functions(chunked, lambda cost, chunk: steps_of(cost, chunk, max_bytes, max_count), "_ordinal", SIZE_COLUMN)
    handed = chain.entries(leaves, last_chunk, chain.Limits(max_bytes, max_count))
    return handed.withColumnsRenamed({"worker": "_worker", "node": "_chunk"})


def _with_entries(chunked: DataFrame, last_chunk: int, max_bytes: int, max_count: int) -> DataFrame:
    """Rows with the open file their chunk is handed; there is none where each worker is one chunk."""
    if last_chunk == 0:
        return chunked.withColumns({f: F.lit(0).cast("bigint") for f in chain.ENTRY_FIELDS})
    return chunked.join(checked_broadcast(_entries(chunked, last_chunk, max_bytes, max_count)), ["_worker", "_chunk"])


def _together(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys in one task, in order.

    Hashing a column of its own keeps Spark from taking an earlier join's partitioning for this one: a skewed
    join may split that at run time, and the tasks that follow need whole groups.
    """
    placed = rows.withColumn("_place", F.xxhash64(*keys)).repartition("_place")
    return placed.sortWithinPartitions(*keys, *order).drop("_place")


def assign_segments(
    df: DataFrame,
    worker: str,
    order: list[str],
    cost: Column | None = None,
    max_bytes: int | str | None = None,
    max_count: int | None = None,
    name: str = "segment_id",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``df`` with the 0-based number of the file each element of its worker goes to.

    ``cost`` is what an element adds to its file, see ``json_element_cost``. With neither limit a worker
    fills a single file. ``worker`` must be an integer column without nulls and ``order`` must not tie within
    a worker.
    """
    size, count = _limits(max_bytes, max_count)
    if size == NO_LIMIT and count == NO_LIMIT:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    if size == NO_LIMIT:
        return by_count(df, worker, order, count, name)
    if cost is None:
        raise SpecError("a size limit needs the cost of an element")
    # The cost is taken before the shuffle, so the numbered table carries one extra bigint and no re-reads.
    ranked = with_ordinal(df.withColumn(SIZE_COLUMN, cost), order, [worker], "_ordinal")
    length = _fixed(ranked, size, count)
    if length is not None:
        return ranked.select(*df.columns, F.expr(f"_ordinal div {length}L").alias(name))
    chunked = _in_chunks(ranked, worker, chunk_rows)
    entered = _with_entries(chunked, _last_chunk(ranked, chunk_rows), size, count)
    keep = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    placed = _together(entered, ["_worker", "_chunk"], ["_ordinal"])
    return placed.mapInArrow(_cut_task(size, count, to_arrow_schema(keep)), keep)


def place_units(
    df: DataFrame,
    worker: str,
    order: list[str],
    cost: Column | None = None,
    max_bytes: int | str | None = None,
    max_count: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``df`` clustered for writing: (_worker, _unit, _segment, _size, columns of df), in order within a unit.

    A unit begins with a file, whose number is ``_segment``, and holds whole files; a hot worker has many
    units. Rows are numbered by one range shuffle and placed by one hash shuffle, whatever the limits are.
    With neither limit a worker fills a single file, which a single task has to write.
    """
    size, count = _limits(max_bytes, max_count)
    if cost is None and size != NO_LIMIT:
        raise SpecError("a size limit needs the cost of an element")
    sized = df.withColumn(SIZE_COLUMN, F.lit(1).cast("bigint") if cost is None else cost)
    out = [*UNIT_COLUMNS, SIZE_COLUMN, *df.columns]
    keys = ["_worker", "_unit"]
    if size == NO_LIMIT and count == NO_LIMIT:
        zero = F.lit(0).cast("bigint")
        one_unit = sized.withColumns({"_worker": F.col(worker).cast("bigint"), "_unit": zero, "_segment": zero})
        return _together(one_unit.select(*out), keys, order)
    ranked = with_ordinal(sized, order, [worker], "_ordinal")
    length = _fixed(ranked, size, count)
    chunked = _in_chunks(ranked, worker, length or chunk_rows)
    if length is not None:
        units = chunked.withColumns({"_unit": F.col("_chunk"), "_segment": F.col("_chunk")})
        return _together(units.select(*out), keys, order)
    last_chunk = _last_chunk(ranked, chunk_rows)
    if last_chunk == 0:
        zero = F.lit(0).cast("bigint")
        return _together(chunked.withColumns({"_unit": zero, "_segment": zero}).select(*out), keys, order)
    entered = _with_entries(chunked.select("_worker", "_chunk", "_ordinal", SIZE_COLUMN), last_chunk, size, count)
    starts = entered.groupBy("_worker", "_chunk").applyInPandas(_first_start_task(size, count), _START_SCHEMA)
    starts = checked_broadcast(materialise(starts, "starts"))
    # Rows before a chunk's first file start belong with the chunk in which their file began.
    unit = F.when(F.col("_ordinal") >= F.col("first_start"), F.col("_chunk")).otherwise(F.col("open_unit"))
    units = chunked.join(starts, ["_worker", "_chunk"]).withColumns({"_unit": unit, "_segment": F.col("first_segment")})
    return _together(units.select(*out), keys, order)


def segment_totals(df: DataFrame, worker: str, size: Column, segment: str = "segment_id") -> DataFrame:
    """Elements and bytes per file."""
    return df.groupBy(worker, segment).agg(F.count("*").alias("n"), F.sum(size).cast("bigint").alias("bytes"))


def file_name(job: str, worker: Column, segment: Column, extension: str) -> Column:
    """``{job}-{worker}-{count}.{ext}``."""
    return F.format_string(f"{job.replace('%', '%%')}-%d-%d.{extension}", worker, segment)


def file_path(job: str, worker: Column, segment: Column, extension: str) -> Column:
    """``{job}/sink/{worker}/{job}-{worker}-{count}.{ext}``."""
    folder = F.format_string(f"{job.replace('%', '%%')}/sink/%d/", worker)
    return F.concat(folder, file_name(job, worker, segment, extension))


def object_key(name: Column) -> Column:
    """An object's key is the file name without its extension."""
    return F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"\.[^.]*$", "")
