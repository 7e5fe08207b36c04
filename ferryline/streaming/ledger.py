"""Short tables that a streaming run keeps beside its checkpoint, one for each micro-batch.

A micro-batch that Spark runs again writes its table again and finds those of the batches before it unchanged, so
what is derived from them is the same each time, also after a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Tables of one kind below ``{checkpoint}/ferryline/{name}``; a batch without one counts as an empty table."""

    def __init__(self, spark: SparkSession, checkpoint: str, name: str, schema: str) -> None:
        self.spark, self.schema = spark, schema
        self.root = f"{checkpoint.rstrip('/')}/ferryline/{name}"

    def _path(self, batch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{batch}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{batch}")

    def read(self, batch: int) -> DataFrame:
        path, files = self._path(batch)
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path.toString())

    def read_all(self) -> DataFrame:
        path, files = self._path(0)
        if not files.exists(path.getParent()):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.root)

    def drop(self, batch: int) -> None:
        path, files = self._path(batch)
        files.delete(path, True)
