"""The mutation log: its schema, and building, numbering and splitting it.

A row is a put (op 0), a point delete (op 1) or a range delete (op 2) of [key, end). lsn orders all rows; ts is nanoseconds
since the epoch and only breaks ties. layer and run_id say where a row is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sweep import cuts_of, halved

PUT, DELETE, RANGE_DELETE = 0, 1, 2
MOST_LSN = 2**63 - 1


def schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    key, value = key or T.BinaryType(), value or T.BinaryType()
    return T.StructType([
        T.StructField("op", T.IntegerType(), False), T.StructField("key", key, False), T.StructField("end", key), T.StructField("value", value),
        T.StructField("lsn", T.LongType(), False), T.StructField("ts", T.LongType()), T.StructField("layer", T.IntegerType()), T.StructField("run_id", T.LongType()),
    ])


def empty(spark: SparkSession, key: T.DataType | None = None, value: T.DataType | None = None) -> DataFrame:
    return spark.createDataFrame([], schema(key, value))


def points(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") < RANGE_DELETE).drop("end")


def ranges(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c not in ("op", "key", "end", "value")]
    return log.where(F.col("op") == RANGE_DELETE).select(F.col("key").alias("start"), "end", *rest)


def record_order() -> list[Column]:
    """Keys ascending, of one key the newest first; a range delete sorts under its start."""
    return [F.col("key").asc(), F.col("lsn").desc()]


def numbered(batch: DataFrame, base: int, order: list[str]) -> DataFrame:
    """lsn = base + 1, base + 2, ... in the order of the given columns, which must tell rows apart.

    Rows are numbered inside buckets of the order and shifted by the rows in the buckets before, so that no task sees all of them. A
    row's bucket follows from its columns alone, so that a task that runs again deals it as before.
    """
    rows = batch.withColumn("_order", F.struct(*order))
    parted = halved(rows, cuts_of(rows.select("_order"), flat=True), "_part", "_order").drop("_order")
    before = parted.groupBy("_part").count()
    before = before.select(F.col("_part").alias("_p"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_shift"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parted.withColumn("_n", inner).join(F.broadcast(before), F.col("_part") == F.col("_p"))  # sweep.MOST_BUCKETS rows at most
    return out.withColumn("lsn", (F.lit(base) + F.col("_shift") + F.col("_n")).cast("long")).drop("_part", "_p", "_n", "_shift")


def invalid(log: DataFrame) -> DataFrame:
    """The rows that may not be written, with the reason as column problem."""
    long = lambda c: F.octet_length(c) > 0
    problem = (
        F.when(F.col("key").isNull() | ~long("key"), "empty key")
        .when((F.col("op") == PUT) & (F.col("value").isNull() | ~long(F.col("value").cast("string"))), "empty value")
        .when((F.col("op") == RANGE_DELETE) & (F.col("end").isNull() | ~long("end")), "empty end")
        .when((F.col("op") == RANGE_DELETE) & (F.col("key") >= F.col("end")), "start is not below end")
        .when((F.col("lsn") < 0) | F.col("lsn").isNull(), "lsn out of range")
    )
    return log.withColumn("problem", problem).where(F.col("problem").isNotNull())
