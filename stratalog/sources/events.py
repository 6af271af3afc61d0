"""The events table as a mutation log, and the tables as key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_LENGTH = 500


def _key(user: Column, k: Column) -> Column:
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 6, "0"), F.lit("/"), F.lpad(k.cast("string"), 3, "0"))


def _user(key: str, default: str) -> int:
    """The user's number in a key or the beginning of one."""
    return int((key[1:7] + default * 6)[:6])


def event_log(spark: SparkSession, sf_dir: str, keys: tuple[str, str] | None = None) -> DataFrame:
    """The events table as a log.

    A run is RUN_LENGTH mutations. keys: a range of keys that are wanted; as a record bears only on keys of its own user, it
    becomes a range of users that reaches the scan.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if keys:
        e = e.where(F.col("user_id").between(_user(keys[0], "0"), _user(keys[1], "9")))
    return as_log(e)


def as_log(e: DataFrame) -> DataFrame:
    """op, key, end, value, lsn, ts, run_id: errors delete their key, those with k >= 80 a range of 25 keys of their user, all else puts."""
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    op = F.when((F.col("event_type") == "error") & (F.col("k") >= 80), 2).when(F.col("event_type") == "error", 1).otherwise(0)
    low = (F.col("k") - 80) * 5
    return e.withColumn("op", op).select(
        "op",
        F.when(F.col("op") == 2, _key(F.col("user_id"), low)).otherwise(_key(F.col("user_id"), F.col("k"))).alias("key"),
        F.when(F.col("op") == 2, _key(F.col("user_id"), low + 25)).alias("end"),
        F.when(F.col("op") == 0, F.col("value")).alias("value"),
        (F.col("event_id") + 1).alias("lsn"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") * 1000).alias("ts"),
        F.expr(f"event_id div {RUN_LENGTH}").alias("run_id"),
    )


def layered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_log with layer: 0 is the newest run, 1 the two before, 2 all others."""
    newest = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.expr(f"event_id div {RUN_LENGTH}")).alias("newest")).scalar()
    layer = F.when(F.col("run_id") == newest, 0).when(F.col("run_id") >= newest - 2, 1).otherwise(2)
    return event_log(spark, sf_dir).withColumn("layer", layer)


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys to look up, some of them absent."""
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(_key(c % 150, (c * 7) % 100).alias("key")).distinct()
