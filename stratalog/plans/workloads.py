"""Key-value workloads A to F as batches: the state that a stream of reads, updates, inserts, scans and read-modify-writes leaves, and what it read.

A scan counts as one read of the key it starts from; the keys of its range are neither read nor counted.

The stream is derived from the events table: one operation an event, its kind drawn by a hash of the event's number, its key
by the user. Keys are loaded before the first operation. Operations are a log, so the final state is its newest version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import latest


@dataclass(frozen=True)
class Mix:
    """Per cent of operations; what is left are reads."""

    update: int = 0
    insert: int = 0
    scan: int = 0
    modify: int = 0


MIXES = {"a": Mix(update=50), "b": Mix(update=5), "c": Mix(), "d": Mix(insert=5), "e": Mix(insert=5, scan=95), "f": Mix(modify=50)}


def operations(spark: SparkSession, sf_dir: str, mix: Mix) -> DataFrame:
    """lsn, kind, key, value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    draw = F.pmod(F.col("event_id") * 7919, F.lit(100))
    kind, below = F.when(F.lit(False), ""), 0
    for name in ("update", "insert", "scan", "modify"):
        if share := getattr(mix, name):
            kind = kind.when((draw >= below) & (draw < below + share), name)
            below += share
    kind = kind.otherwise("read")
    user = F.concat(F.lit("user"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    key = F.when(F.col("kind") == "insert", F.concat(F.lit("user"), F.lpad((F.col("event_id") + 1_000_000).cast("string"), 12, "0"))).otherwise(user)
    return e.withColumn("kind", kind).select((F.col("event_id") + 1).alias("lsn"), "kind", key.alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))


def final_state(ops: DataFrame) -> DataFrame:
    """key, value, reads: the state after all operations, and how often each key was read or scanned from."""
    loaded = ops.where("kind <> 'insert'").select("key").distinct().select("key", F.lit("loaded").alias("value"), F.lit(0).cast("long").alias("lsn"), F.lit(0).cast("long").alias("ts"))
    written = ops.where(F.col("kind").isin("update", "insert", "modify")).select("key", "value", "lsn", F.lit(0).cast("long").alias("ts"))
    reads = ops.where(F.col("kind").isin("read", "scan", "modify")).groupBy("key").agg(F.count(F.lit(1)).alias("reads"))
    return latest(loaded.union(written)).join(reads, "key", "left").select("key", "value", F.coalesce("reads", F.lit(0)).alias("reads"))


def _query(mix: Mix):
    return lambda spark, sf_dir: final_state(operations(spark, sf_dir, mix))


def _sql(mix: Mix) -> str:
    cases, below = "", 0
    for name in ("update", "insert", "scan", "modify"):
        if share := getattr(mix, name):
            cases += f" WHEN d >= {below} AND d < {below + share} THEN '{name}'"
            below += share
    kind = f"CASE{cases} ELSE 'read' END" if cases else "'read'"
    return f"""WITH o AS (SELECT event_id, user_id, {kind} AS kind FROM (SELECT *, (event_id * 7919) % 100 AS d FROM events)),
  k AS (SELECT *, 'user' || lpad(CAST(CASE WHEN kind = 'insert' THEN event_id + 1000000 ELSE user_id END AS VARCHAR), 12, '0') AS key FROM o),
  w AS (SELECT key, arg_max('v' || event_id, event_id) FILTER (WHERE kind IN ('update', 'insert', 'modify')) AS v, count(*) FILTER (WHERE kind IN ('read', 'scan', 'modify')) AS reads FROM k GROUP BY key)
  SELECT key, coalesce(v, 'loaded') AS value, reads FROM w"""


QUERIES = {f"ycsb_{name}": _query(mix) for name, mix in MIXES.items()}
SQL = {f"ycsb_{name}": _sql(mix) for name, mix in MIXES.items()}
