"""Exact top-k search by inner product with a table of distances to pivots.

Components become integers, ``floor(256 * x)``. With one more coordinate that gives all rows the largest norm, the
highest inner product is the smallest distance, so the triangle inequality holds: a row is no nearer to a query than
the largest difference of their distances to any pivot. Rows are taken in the order of that bound, and a query is
done once the bound exceeds its k-th distance.

Queries and rows meet in cells of bounded size: each group of queries visits every group of rows, the best k of each
cell are ranked at the end. Pivots are spread points of a sample of ``POOL`` rows; every row has its place in the
table, and the search is exact whichever pivots are taken.

Distances are floats, which tell whole numbers apart only up to a point. Rows with a squared integer norm of 2 ** 52 or
more, "long" ones, therefore stay out of the pivot table: every score that involves one is worked out in whole numbers,
in the same cells.

Defined cases: vectors that are null, hold null or non-finite components (256 times which counts as well), or have no id
take no part. A score beyond 64 bits that would be among the best is an error. Shorter vectors count as padded with zeros, and one without components is all zeros.
Rows that share an id are one candidate and one query, with the highest score of any of their vectors. Ties go to the
smaller id. A query without candidates has no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
POOL = 1024
PIVOTS = 16
ROWS_A_CELL = 16_384
QUERIES_A_CELL = 1_024
_LONG = float(1 << 52)
_FIRST = 128
# Stands for scores too low for 64 bits.
_LOWEST = -(2**63 - 1)

ROWS_SCHEMA = "vec_id long, width int, vector binary, norm double"
FOUND_SCHEMA = "query_id long, vec_id long, score long"


def integer_rows(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, width, vector, norm): the rows that take part; vectors as doubles with integer values."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name is None or not values.is_valid or values.values.null_count:
                    continue
                whole = np.floor(SCALE * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(whole).all():
                    with np.errstate(over="ignore"):
                        rows.append((name, len(whole), whole.tobytes(), float(whole @ whole)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int32(), pa.binary(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "width", "vector", "norm"])

    return vectors.select(F.col(vec_id).cast("long"), vector).mapInArrow(emit, ROWS_SCHEMA)


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, packed in zip(out, vectors, strict=True):
        values = np.frombuffer(packed, np.float64)
        row[: len(values)] = values
    return out


def spread_points(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    picked, nearest = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < count and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def _to_pivots(points: np.ndarray, pivots: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Distances to the pivots of points with the given last coordinate (rows: lifted to the norm; queries: 0)."""
    top = pivots[:, -1]
    square = (points**2).sum(axis=1) + lift**2
    squared = square[:, None] + (pivots**2).sum(axis=1) - 2 * (points @ pivots[:, :-1].T + lift[:, None] * top)
    return np.sqrt(np.maximum(squared, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int, unlike: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best, ties to the smaller id; an id counts once. ``unlike``: no id occurs twice."""
    if unlike and len(scores) > k:
        kept = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))
    if not unlike:
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return scores[order[:k]], ids[order[:k]]


def nearest_in_cell(ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, point: np.ndarray, norm: float, k: int, unlike: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best (score, id) of a cell for a query, taken in the order of the bound; an infinite bound keeps a row out."""
    slack, base = 4e-6 * math.sqrt(norm) + 1e-9, float(point @ point) + norm
    scores, names = np.zeros(0), np.zeros(0, np.int64)
    todo, step, reach = np.flatnonzero(np.isfinite(bound)), _FIRST, np.inf
    while len(todo):
        todo = todo[bound[todo] <= reach]
        if step < len(todo):
            cut = np.argpartition(bound[todo], step)
            now, todo = todo[cut[:step]], todo[cut[step:]]
        else:
            now, todo = todo, todo[:0]
        # A product over all rows is cheaper than picking most of them.
        fresh = (rows @ point)[now] if 2 * len(now) > len(rows) else rows[now] @ point
        scores, names = _best(np.concatenate([scores, fresh]), np.concatenate([names, ids[now]]), k, unlike)
        if len(scores) == k:
            reach = math.sqrt(max(base - 2 * scores[-1], 0)) + slack
        step *= 8
    return scores, names


def whole_scores(point: np.ndarray, norm: float, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers; one that is too high for 64 bits is an error, one too low is ``_LOWEST``."""
    out = np.empty(len(rows), np.int64)
    # No component is longer than its vector, and no part of a sum beyond the product of the lengths.
    reach, lengths = math.sqrt(norm), np.sqrt(norms)
    plain = (reach < 2.0**61) & (lengths < 2.0**61) & (np.minimum(reach, 2.0**61) * np.minimum(lengths, 2.0**61) < 2.0**61)
    if plain.any():
        out[plain] = rows[plain].astype(np.int64) @ point.astype(np.int64)
    wide = [int(v) for v in point.tolist()] if not plain.all() else []
    for at in np.flatnonzero(~plain):
        score = sum(a * int(b) for a, b in zip(wide, rows[at].tolist(), strict=True))
        if score >= 1 << 63:
            raise ValueError(f"a score of {score} is beyond 64 bits")
        out[at] = max(score, _LOWEST)
    return out


def _search(k: int, norm: float, pivots: np.ndarray):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        width = pivots.shape[1] - 1
        all_ids, all_rows, norms = right["vec_id"].to_numpy(), _matrix(right["vector"].to_pylist(), width), right["norm"].to_numpy()
        short = norms < _LONG
        ids, rows = (all_ids, all_rows) if short.all() else (all_ids[short], all_rows[short])
        lift = np.sqrt(np.maximum(norm - norms[short], 0))
        # Distances of the pivot table: a line for each pivot.
        row_pivots = np.ascontiguousarray(_to_pivots(rows, pivots, lift).T.astype(np.float32))
        names, lengths = left["vec_id"].to_pylist(), left["norm"].to_pylist()
        points = _matrix(left["vector"].to_pylist(), width)
        unlike = len(np.unique(all_ids)) == len(all_ids)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for name, point, length in zip(names, points, lengths, strict=True):
            scores, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if length < _LONG:
                bound = np.zeros(len(ids), np.float32)
                near = _to_pivots(point[None, :], pivots, np.zeros(1)).astype(np.float32)[0]
                for line, distance in zip(row_pivots, near, strict=True):
                    np.maximum(bound, np.abs(line - distance), out=bound)
                bound[ids == name] = np.inf
                scores, best = nearest_in_cell(ids, rows, bound, point, norm, k, unlike)
            # What the table does not hold: long rows, or all rows for a long query.
            rest = (all_ids != name) & (~short if length < _LONG else True)
            if rest.any():
                more = whole_scores(point, length, all_rows[rest], norms[rest])
                scores, best = _best(np.concatenate([scores.astype(np.int64), more]), np.concatenate([best, all_ids[rest]]), k, unlike)
            found.append((np.full(len(best), name), best, scores.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best rows for each row where ``is_query`` holds.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    rows = integer_rows(vectors, vec_id, vector)
    size = rows.agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries"), F.max(F.when(F.col("norm") < _LONG, F.col("norm"))).alias("norm"),
        F.max("width").alias("width"),
    ).head()
    norm, width = float(size["norm"] or 0), int(size["width"] or 0)
    pool = rows.filter(F.col("norm") < _LONG).orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(POOL).collect()
    points = _matrix([bytes(r["vector"]) for r in pool], width) if pool else np.zeros((1, width))
    lifted = np.column_stack([points, np.sqrt(np.maximum(norm - (points**2).sum(axis=1), 0))])
    pivots = spread_points(lifted, PIVOTS)

    row_groups, query_groups = max(1, -(-size["n"] // ROWS_A_CELL)), max(1, -(-size["queries"] // QUERIES_A_CELL))

    def group(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit("cell")), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    dealt_rows = rows.withColumn("row_group", group(row_groups)).withColumn("query_group", every(query_groups))
    dealt_queries = rows.filter(is_query).withColumn("query_group", group(query_groups)).withColumn("row_group", every(row_groups))
    cell = ["row_group", "query_group"]
    met = dealt_queries.groupBy(*cell).cogroup(dealt_rows.groupBy(*cell))
    found = met.applyInArrow(_search(k, norm, pivots), FOUND_SCHEMA)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    too_low = F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")
    score = F.when(F.col("score") == _LOWEST, too_low).otherwise(F.col("score")).alias("score")
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
