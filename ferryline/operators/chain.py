"""What a stretch of elements does with the file it is handed open, as a function, and chains of such functions.

A file that is open when a stretch begins holds some bytes and some elements; fuller files end sooner. So a stretch is a
monotone step function from the open file to (files closed, file left open), and only its steps are kept. Two stretches
in a row are one: ``then`` composes them. Steps whose outcomes meet again fall together, and an open file ends no later
than a fresh one would, so a function never has more steps than a file has elements, however long the stretch is.

Functions of neighbouring stretches are composed in a tree, ``FAN`` at a time, and the files handed to them are
passed down the same tree: every task sees ``FAN`` functions, whatever a worker holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferryline.session import materialise

FAN = 16
# The file that was handed in is still the open one.
_SAME = -1

_ARRAYS = ("from_cost", "from_count", "closed", "left_cost", "left_count", "unit")
_FUNCTION_SCHEMA = "worker bigint, node bigint, steps binary"
ENTRY_FIELDS = ("base_segment", "open_cost", "open_count", "open_unit")
_ENTRY_SCHEMA = "worker bigint, node bigint, " + ", ".join(f"{f} bigint" for f in ENTRY_FIELDS)


@dataclass(frozen=True)
class Limits:
    max_bytes: int
    max_count: int


@dataclass(frozen=True)
class Steps:
    """``n`` elements of ``cost`` bytes. Entry 0 of the arrays is for no open file; entry i applies from ``from_cost`` and ``from_count`` on,
    that is when the elements before it do not fill the open file. ``unit``: the stretch in which the file left open began."""

    n: int
    cost: int
    from_cost: np.ndarray
    from_count: np.ndarray
    closed: np.ndarray
    left_cost: np.ndarray
    left_count: np.ndarray
    unit: np.ndarray

    def reached(self, cost: np.ndarray, count: np.ndarray, limits: Limits) -> np.ndarray:
        """The entry for each open file; 0 where there is none."""
        by_cost = np.searchsorted(self.from_cost[1:], limits.max_bytes - cost, side="left")
        by_count = np.searchsorted(self.from_count[1:], limits.max_count - count, side="left")
        return np.where(count == 0, 0, np.minimum(by_cost, by_count))

    def outcomes(self, cost: np.ndarray, count: np.ndarray, limits: Limits) -> tuple[np.ndarray, ...]:
        """(closed, left_cost, left_count, unit) for open files, or none where ``count`` is 0."""
        through = (count > 0) & (cost + self.cost < limits.max_bytes) & (count + self.n < limits.max_count)
        at = self.reached(cost, count, limits)
        closed = self.closed[at] + (count > 0)
        return (
            np.where(through, 0, closed),
            np.where(through, cost + self.cost, self.left_cost[at]),
            np.where(through, count + self.n, self.left_count[at]),
            np.where(through, _SAME, self.unit[at]),
        )

    def then(self, after: Steps, limits: Limits) -> Steps:
        """This stretch and the next one as one."""
        closed, left_cost, left_count, unit = after.outcomes(self.left_cost, self.left_count, limits)
        unit = np.where(unit == _SAME, self.unit, unit)
        parts = [[self.from_cost, self.from_count, self.closed + closed, left_cost, left_count, unit]]
        if not self.closed[0]:
            # A file may pass through the first stretch and end in the second; no later than a fresh one does.
            last = int(after.reached(np.array([self.cost]), np.array([self.n]), limits)[0]) if self.n else len(after.closed) - 1
            own = [getattr(after, name)[1 : last + 1] for name in _ARRAYS]
            parts.append([own[0] + self.cost, own[1] + self.n, *own[2:]])
        joined = [np.concatenate(columns) for columns in zip(*parts, strict=True)]
        return Steps(self.n + after.n, self.cost + after.cost, *joined).merged()

    def merged(self) -> Steps:
        """Without steps that change nothing."""
        outcome = np.stack([getattr(self, name) for name in _ARRAYS[2:]])
        kept = np.append([True, True], (outcome[:, 2:] != outcome[:, 1:-1]).any(axis=0))[: len(self.closed)]
        return Steps(self.n, self.cost, *(getattr(self, name)[kept] for name in _ARRAYS))

    def packed(self) -> bytes:
        arrays = [pa.array(np.diff(getattr(self, name), prepend=0), pa.int64()) for name in _ARRAYS]
        head = {"n": str(self.n), "cost": str(self.cost)}
        batch = pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(name, pa.int64()) for name in _ARRAYS], metadata=head))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpacked(data: bytes) -> Steps:
        with pa.ipc.open_stream(data) as stream:
            head, batch = stream.schema.metadata, stream.read_next_batch()
        return Steps(int(head[b"n"]), int(head[b"cost"]), *(np.cumsum(batch.column(i).to_numpy()) for i in range(len(_ARRAYS))))


def functions(chunked: DataFrame, steps_of, ordinal: str, size: str) -> DataFrame:
    """(worker, node, steps): the function of each chunk; ``steps_of(costs, chunk)`` works it out."""

    def task(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cost = rows.sort_values(ordinal)[size].to_numpy(np.int64)
        return pd.DataFrame([{"worker": keys[0], "node": keys[1], "steps": steps_of(cost, int(keys[1])).packed()}])

    return chunked.select("_worker", "_chunk", ordinal, size).groupBy("_worker", "_chunk").applyInPandas(task, _FUNCTION_SCHEMA)


def _composed(level: DataFrame, limits: Limits) -> DataFrame:
    def task(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole: Steps | None = None
        for packed in rows.sort_values("node")["steps"]:
            own = Steps.unpacked(packed)
            whole = own if whole is None else whole.then(own, limits)
        return pd.DataFrame([{"worker": keys[0], "node": keys[1], "steps": whole.packed()}])

    grouped = level.withColumn("parent", F.expr(f"node div {FAN}L")).groupBy("worker", "parent")
    return grouped.applyInPandas(task, _FUNCTION_SCHEMA)


def _handed_down(level: DataFrame, entries: DataFrame, limits: Limits) -> DataFrame:
    """The open file each node of a level is handed, from those that their parents are handed."""

    def task(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        segment, cost, count, unit = (int(rows.iloc[0][f]) for f in ENTRY_FIELDS)
        out = []
        for row in rows.itertuples(index=False):
            out.append((keys[0], row.node, segment, cost, count, unit))
            closed, left_cost, left_count, left = Steps.unpacked(row.steps).outcomes(*(np.array([v]) for v in (cost, count)), limits)
            segment, cost, count = segment + int(closed[0]), int(left_cost[0]), int(left_count[0])
            unit = unit if left[0] == _SAME else int(left[0])
        return pd.DataFrame(out, columns=["worker", "node", *ENTRY_FIELDS])

    above = entries.withColumnRenamed("node", "parent")
    joined = level.withColumn("parent", F.expr(f"node div {FAN}L")).join(above, ["worker", "parent"])
    return joined.groupBy("worker", "parent").applyInPandas(task, _ENTRY_SCHEMA)


def entries(leaves: DataFrame, last_node: int, limits: Limits) -> DataFrame:
    """(worker, node, ...): the open file each of the ``leaves`` is handed; nodes of a worker go from 0 to at most ``last_node``."""
    levels = [materialise(leaves, "steps")]
    for _ in _heights(last_node):
        levels.append(materialise(_composed(levels[-1], limits), "steps"))
    zero = F.lit(0).cast("bigint")
    found = levels.pop().select("worker", "node", *(zero.alias(f) for f in ENTRY_FIELDS))
    while levels:
        found = _handed_down(levels.pop(), found, limits)
    return materialise(found, "entries")


def _heights(last_node: int) -> Iterator[int]:
    """Levels above the leaves, until a worker has one node."""
    height = 0
    while last_node:
        last_node //= FAN
        height += 1
        yield height
