"""Exact row positions, globally or per key, without a single-task window.

``row_number() over (partition by key order by seq)`` puts a whole key into one task; a key holding a third
of a large table would never finish. Here rows fall into buckets between boundary rows of (key, order), so a hot
key is spread over many buckets; each row is numbered inside its key's part of a bucket, and a short table of
counts supplies how many rows of the same key lie in earlier buckets.

The boundaries are literals taken from a sample, so every pass over the input puts a row into the same bucket and
nothing has to be written in between. Where they lie bears on the balance alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferryline.session import checked_broadcast

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 65_536
_SAMPLED_PER_BUCKET = 8


def _boundaries(df: DataFrame, columns: Sequence[str]) -> list[Row]:
    """Rows that part ``df`` into buckets of similar size; fewer than ``MAX_BUCKETS``."""
    narrow = df.select(*columns)
    rows = narrow.count()
    buckets = min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET))
    if buckets < 2:
        return []
    wanted = buckets * _SAMPLED_PER_BUCKET
    picked = F.pmod(F.xxhash64(*columns), F.lit(max(1, rows // wanted))) == 0
    sample = narrow.filter(picked).orderBy(*columns).limit(4 * wanted).collect()
    steps = len(sample) / buckets
    return list(dict.fromkeys(sample[int(i * steps)] for i in range(1, buckets))) if len(sample) >= buckets else sample


def _constant(values: list, kind: T.DataType) -> Column:
    """An array of constants; whole numbers and texts in one go, other types one by one."""
    if isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType)):
        return F.from_json(F.lit(json.dumps(values)), T.ArrayType(kind))
    return F.lit(values).cast(T.ArrayType(kind))


def _reached(df: DataFrame, columns: Sequence[str], marks: list[Column], nulls: list[bool], at: Column) -> Column:
    """Whether a row has reached the mark at a place: a comparison column by column, a null before all values."""
    out = F.lit(True)
    for i, name in reversed(list(enumerate(columns))):
        mark, here = F.get(marks[i], at), F.col(name)
        less, same = mark < here, mark == here
        if df.schema[name].nullable or nulls[i]:
            less = F.coalesce(less, mark.isNull() & here.isNotNull())
            same = mark.eqNullSafe(here)
        out = less | (same & out)
    return out


def _with_bucket(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of boundaries a row has reached.

    The binary search is a column for each step, so that every step is a short comparison in generated code which
    looks its mark up in a constant array, whatever the number of boundaries. Nothing may be joined by the column: a
    join's key is followed back through all steps while the query is planned, and each step names the one before several times.
    """
    marks = _boundaries(df, columns)
    listed = [_constant([m[i] for m in marks], df.schema[name].dataType) for i, name in enumerate(columns)] if marks else []
    nulls = [any(m[i] is None for m in marks) for i in range(len(columns))]
    found = df.withColumn(name, F.lit(0))
    for k in range(len(marks).bit_length() - 1, -1, -1):
        at = F.col(name) + ((1 << k) - 1)
        further = (at < len(marks)) & _reached(df, columns, listed, nulls, at)
        found = found.withColumn(name, F.col(name) + F.when(further, 1 << k).otherwise(0))
    return found


def with_ordinal(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """Add ``name``: the 0-based position of each row among the rows of equal ``keys`` in ``order``.

    ``order`` must not tie within a key, else tied rows get an arbitrary order among themselves.
    ``total`` optionally names a column for the number of rows of the key. Two short passes over the key and
    order columns, and one shuffle of the rows.
    """
    keys, order = list(keys), list(order)
    placed = _with_bucket(df, [*keys, *order], "_bucket")
    # One row per (bucket, key) that meet: at most buckets + keys rows.
    counts = placed.groupBy(F.col("_bucket").alias("_at"), *[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count("*").alias("_n"))
    run_keys = [f"_k_{k}" for k in keys]
    by_key = Window.partitionBy(*run_keys) if run_keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    here = by_key.orderBy("_at").rowsBetween(Window.currentRow, Window.currentRow)
    runs = counts.select(
        F.first("_at").over(here).alias("_at"),
        *run_keys,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    runs = checked_broadcast(runs)

    # The bucket goes into the join as a window's result, behind which keys are not followed.
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    own_bucket = F.first("_bucket").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matches: Column = F.col("_own_bucket") == F.col("_at")
    for key in keys:
        matches = matches & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    out = [*df.columns, (F.col("_before") + F.col("_within") - 1).alias(name)]
    if total is not None:
        out.append(F.col("_total").alias(total))
    ranked = placed.select("*", F.row_number().over(inside).alias("_within"), own_bucket.alias("_own_bucket"))
    return ranked.join(runs, matches).select(*out)


def even_split(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """Cut the ordered rows into ``parts`` contiguous chunks whose sizes differ by at most one.

    Row ``i`` of ``n`` lands in chunk ``floor(i * parts / n)``.
    """
    ranked = with_ordinal(df, order, name="_i", total="_n")
    return ranked.withColumn(name, F.expr(f"cast((_i * {int(parts)}L) div _n as int)")).drop("_i", "_n")


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (all of them when there are fewer)."""
    return df.orderBy(*order).limit(n)


def limit_workers(df: DataFrame, requested: int) -> DataFrame:
    """At most ``requested`` tasks, fewer when there is less input; nothing is shuffled."""
    return df.coalesce(max(1, requested))
