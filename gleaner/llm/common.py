"""Shared plumbing: scratch tables in the shared folder, bounded Arrow batches, row iteration."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Spark hands to a Python worker at once; texts may be long.
ARROW_ROWS = 200

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, one under /tmp, on a single machine only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        given = f"file:///tmp/checkpoints/{os.getpid()}"
    return given.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch() -> list[str]:
    """The scratch paths in use, in order."""
    return [path for _, path in _written]


def release(paths: list[str]) -> None:
    """Delete scratch tables that no result still to be read rests on."""
    for spark, path in [w for w in _written if w[1] in set(paths)]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove((spark, path))


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner cleans it
            return


def ship_package(spark: SparkSession) -> None:
    """Give the package's source to the Python workers of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    held = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(held, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(held))


def bounded_batches(spark: SparkSession) -> None:
    """Before Python stages: the package goes to the workers, and Arrow batches get ARROW_ROWS rows at most."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns' values, row by row, with few rows as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine; workers stay for later stages, whose memory this then isn't."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def emit(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed c0, c1, ... so that joined columns can't clash with them, and the new names by the old ones."""
    names = [f"c{n}" for n in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint where it has at most so many (narrow) rows; else as it is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
