"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_its_sql(spark, sf, db, name):
    frame = contract.queries()[name](spark, sf)
    cursor = db.execute(contract.oracle_sql()[name])
    want = shape([d[0] for d in cursor.description], cursor.fetchall())
    got = shape(frame.columns, frame.collect())
    assert got == want
    assert got[1], "an empty result shows nothing"


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_intermediate_tables_lie_in_the_checkpoint_folder(spark):
    from ferryline.session import materialise

    written = materialise(spark.range(3), "numbers")
    configured = spark.conf.get("spark.checkpoint.dir")
    assert all(configured in path for path in written.inputFiles()) and written.count() == 3
    assert os.path.isdir(configured)


@pytest.mark.parametrize("gone", [("ferryline/llm",), ("ferryline/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_package_stands_without_the_pipeline_operators(tmp_path, gone):
    from ferryline.plans.queries import QUERIES

    root = Path(contract.__file__).parent
    left_out = shutil.ignore_patterns(".git", "tests", "__pycache__", *(Path(g).name for g in gone))
    shutil.copytree(root, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; print(*e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    listed = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, check=True).stdout.split()
    assert set(QUERIES) <= set(listed)
    assert ("ferryline/llm" in gone) == (set(QUERIES) == set(listed)) and "pipeline" not in listed


def test_files_over_chunks_are_cut_at_60_000_bytes(spark, sf):
    """A limit that suits the folder's size, so that workers have several files, each of many chunks."""
    files = contract.queries()["segment_size_over_chunks"](spark, sf).collect()
    last = {worker: max(f.segment_id for f in files if f.worker == worker) for worker in {f.worker for f in files}}
    assert sum(last.values()) > 0
    full = [f.bytes + 2 * f.n for f in files if f.segment_id < last[f.worker]]
    assert all(60_000 <= size < 400_000 for size in full)
