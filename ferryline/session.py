"""Session settings and the shared folder intermediate tables are written to."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"

# A lookup side is broadcast only after it has been counted and found no longer than this.
MAX_BROADCAST_ROWS = 50_000

_open_scopes: list[list[str]] = []
_local_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(app_name: str = "ferryline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on (UTC, AQE with skew handling, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a ``local`` session, which is one
    machine by definition, may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    app_id = spark.conf.get("spark.app.id", "local")
    if app_id not in _local_dirs:
        holder = tempfile.TemporaryDirectory(prefix="ferryline-", ignore_cleanup_errors=True)
        _local_dirs[app_id] = holder
        atexit.register(holder.cleanup)
    return _local_dirs[app_id].name


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; no two calls return the same one."""
    return f"{shared_dir(spark)}/ferryline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where later steps must see the very same rows twice (row positions). The table outlives lost
    executors, is written once, and later readers prune its columns.
    """
    path = shared_path(df.sparkSession, label)
    for written in _open_scopes:
        written.append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the tables ``materialise`` writes inside, at the end; results must be written by then.

        with intermediates_dropped(spark):
            with_ordinal(df, ["seq"]).write.parquet(target)

    Without it the tables stay in the shared folder, for whoever clears that folder.
    """
    written: list[str] = []
    _open_scopes.append(written)
    try:
        yield
    finally:
        _open_scopes.pop()
        for name in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_if_short(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None; never more than that is fetched."""
    head = df.limit(max_rows + 1).collect()
    return head if len(head) <= max_rows else None


def broadcast_rows(spark: SparkSession, rows: list[Row], schema: StructType) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is.

    When the check passes the fetched rows are the side, so the side is computed once. When it fails the join
    that follows is an ordinary shuffle join.
    """
    rows = collect_if_short(df, max_rows)
    return df if rows is None else broadcast_rows(df.sparkSession, rows, df.schema)
