"""Places of rows within cells, with large cells dealt out to many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A cell's rows go to at least so many groups, and to more where a group would otherwise get more rows than this.
LEAST_GROUPS = 256
ROWS_A_GROUP = 50_000


def numbered(df: DataFrame, cell: str, order: list[str], total: int, name: str = "rank") -> DataFrame:
    """``df`` with each row's 0-based place in its cell, without gaps.

    Rows of a cell are dealt by a hash of ``order`` into groups; groups stand in the order of their number and rows in
    a group in that of ``order``. ``df`` has to give the same rows each time it is read (a written table).
    """
    groups = max(LEAST_GROUPS, -(-total // ROWS_A_GROUP))
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy(cell, "_group").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(cell).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(cell, "_group", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(cell, "_group").orderBy(*order))
    return (
        dealt.join(starts.hint("shuffle_hash"), [cell, "_group"])
        .withColumn(name, F.col("_start") + within - 1)
        .drop("_group", "_start")
    )
