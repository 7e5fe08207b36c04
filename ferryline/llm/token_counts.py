"""Token totals kept up to date by signed deltas.

A batch of changes is a table of signed rows: +1 for an inserted document, -1 for a deleted one, and both for a
revised one, the old state with -1 and the new with +1. ``commit`` adds a batch up by source, language and tokenizer
version and stores the sums under the batch's name; a name that is there already is passed over, so a batch that is
handed in again changes nothing. ``totals`` adds the stored sums up. Sums are added before they are shuffled, so a
source with most of the rows costs no more than another.

A batch is written to a name of its own attempt and then renamed, which a file system does in one step; a run that
dies in between leaves nothing that counts. Two runs that commit the same batch at once write the same sums, and
the second rename finds the name taken.

``compact`` adds the stored batches up into a base, which remembers their names, and then deletes them; the base
takes over by one rename as well. Between that rename and the deletion a batch is in both places and is counted in
the base alone. Readers of totals that were planned before may find their files gone. Totals come from one scan of the
base and one of the batches since, however many. On an object store a rename is a copy and not one step: keep the
folder on a file system.

Defined cases: a null text has no tokens but is a document; a null source or language is a group of its own; equal
rows count as often as they occur; an empty batch is committed with no sums; columns beyond those named are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
NAMES_SCHEMA = "batch string"
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

# Tokenizer versions as patterns of one token: words, and words parted from marks.
VERSIONS = {"words/1": r"[^\x20\x09-\x0D]+", "words/2": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"}


def n_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def signed(docs: DataFrame, sign: int, version: str) -> DataFrame:
    """The rows a batch is made of: each document's keys and its counts times ``sign``."""
    return docs.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"),
        (n_tokens(F.col("text"), version) * sign).alias("n_tokens"),
        (F.coalesce(F.length("text"), F.lit(0)).cast("long") * sign).alias("n_chars"),
    )


def inserted(docs: DataFrame, version: str) -> DataFrame:
    return signed(docs, 1, version)


def deleted(docs: DataFrame, version: str) -> DataFrame:
    return signed(docs, -1, version)


def revised(before: DataFrame, old_version: str, after: DataFrame, new_version: str) -> DataFrame:
    return deleted(before, old_version).unionByName(inserted(after, new_version))


class Rollup:
    """The stored sums below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _named(self, start: str) -> list[str]:
        """The rest of the names in the folder that begin with ``start``."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(self._path(self.folder)))
        return sorted(n.removeprefix(start) for n in names if n.startswith(start))

    def _bases(self) -> list[int]:
        return sorted(map(int, self._named("base=")))

    def _in_base(self) -> DataFrame:
        """Names of the batches that the base holds."""
        bases = self._bases()
        if not bases:
            return self.spark.createDataFrame([], NAMES_SCHEMA)
        return self.spark.read.schema(NAMES_SCHEMA).parquet(f"{self.folder}/base={bases[-1]}/names")

    def _since(self) -> list[str]:
        """Names of the stored batches that the base does not hold."""
        stored = self._named("batch=")
        if not stored or not self._bases():
            return stored
        done = {r["batch"] for r in self._in_base().filter(F.col("batch").isin(stored)).collect()}
        return [n for n in stored if n not in done]

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted({r["batch"] for r in self._in_base().collect()} | set(self._named("batch=")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Stores the sums of a batch; False if a batch of that name was there, whose sums then stay."""
        if not re.fullmatch(r"[A-Za-z0-9.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        target = self._path(f"{self.folder}/batch={batch}")
        if self._fs.exists(target) or not self._in_base().filter(F.col("batch") == batch).isEmpty():
            return False
        attempt = self._path(f"{self.folder}/_attempt-{uuid.uuid4().hex}")
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        sums.write.parquet(attempt.toString())
        if self._fs.rename(attempt, target) and not self._fs.exists(self._path(f"{target.toString()}/{attempt.getName()}")):
            return True
        self._fs.delete(attempt, True)
        self._fs.delete(self._path(f"{target.toString()}/{attempt.getName()}"), True)
        return False

    def compact(self) -> int:
        """Moves the stored batches into a new base and gives their number; run by one process at a time."""
        names, bases = self._since(), self._bases()
        if names:
            attempt, number = f"{self.folder}/_attempt-{uuid.uuid4().hex}", bases[-1] + 1 if bases else 1
            self._summed().write.parquet(f"{attempt}/sums")
            new = self.spark.createDataFrame([(n,) for n in names], NAMES_SCHEMA)
            self._in_base().unionByName(new).write.parquet(f"{attempt}/names")
            if not self._fs.rename(self._path(attempt), self._path(f"{self.folder}/base={number}")):
                raise RuntimeError(f"base {number} of {self.folder} could not be put in place")
        kept = self._bases()[-1:]
        # Also what a run that died after its rename has left.
        held = {r["batch"] for r in self._in_base().collect()}
        for name in (f"batch={n}" for n in self._named("batch=") if n in held):
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        for number in self._bases():
            if number not in kept:
                self._fs.delete(self._path(f"{self.folder}/base={number}"), True)
        return len(names)

    def deltas(self, batches: Sequence[str] | None = None) -> DataFrame:
        """The stored sums of the named batches, by default of the base and all batches since."""
        paths = [f"{self.folder}/batch={n}" for n in (self._since() if batches is None else batches)]
        if batches is None:
            paths += [f"{self.folder}/base={n}/sums" for n in self._bases()[-1:]]
        if not paths:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        # One scan of all; folder names are not taken for columns.
        return self.spark.read.schema(DELTA_SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)

    def _summed(self) -> DataFrame:
        return self.deltas().groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))

    def totals(self) -> DataFrame:
        """The current totals; groups whose documents are all gone are left out."""
        return self._summed().filter(" or ".join(f"{c} <> 0" for c in SUMS))
