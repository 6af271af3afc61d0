"""Folders and tables that the driver and all executors see."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _give_back() -> None:
    """Python workers return freed memory to the system at once instead of keeping it beside the JVM's."""
    pa.set_memory_pool(pa.system_memory_pool())
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):  # glibc
        for option, value in ((-3, 16 << 20), (-1, 24 << 20), (-8, 2)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            mallopt(option, value)


if TaskContext.get():  # not in the driver, or another program that imports this
    _give_back()
#: Bounds of what a Python worker holds of its input at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; where that is unset, a temporary one, but only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
            at = spark.sparkContext.getCheckpointDir()
        found = at
    return found.rstrip("/")


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches of bounded size for Python stages (settings that last, as plans run later), whose workers find this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    return spark


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder; what is there goes when the driver's process ends."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clear(folders: list[str]) -> None:
    for at in folders:
        with contextlib.suppress(OSError):
            fs_, path = filesystem(at)
            fs_.delete_dir(path)


@atexit.register
def _clear_all() -> None:
    _clear(_made)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Folders that are made inside go at its end, not when the driver's process ends. What is read from them must have been written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        gone = _made[before:]
        del _made[before:]
        _clear(gone)


def through_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Tasks that few_files leaves at least.
FILES = 32


def few_files(df: DataFrame) -> DataFrame:
    """df with its partitions worked one after another in at most FILES tasks, or two a core: each of them is as small as before, but a task writes one file."""
    return df.coalesce(max(FILES, 2 * df.sparkSession.sparkContext.defaultParallelism))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is split where more than this share of all rows has it; so many keys at most.
SHARES = 1024


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, salt: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, a table of one row for each value of keys with the number of rows that have it.

    A value that more than a SHARES-th of all rows has (and a hundred) is split into parts of about that size, by a hash of the columns
    salt, so that no task gets a hot group whole. facts is read more than once and should be a table. At most SHARES values are
    that frequent, which bounds what is broadcast. how: inner or left.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    most = max(100, total // SHARES)
    hot = facts.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(facts, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*salt), parts).cast("int")).drop("_parts")
    right = facts.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Also runs on executors: file://, s3://, gs://, hdfs:// or a plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
