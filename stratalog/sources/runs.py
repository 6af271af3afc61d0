"""Sorted runs as Parquet: written in key ranges, in record order inside each, with bloom filters and statistics on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flush, log


def write_run(rows: DataFrame, path: str) -> dict | None:
    """Writes rows (op, key, end, value, lsn, ts) and returns the run's properties; None, and no files, if there are no rows."""
    own = rows.select("op", "key", "end", "value", "lsn", "ts")
    sorted_ = own.repartitionByRange("key").sortWithinPartitions(*log.record_order())
    sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return run_properties(rows.sparkSession, path)


def run_properties(spark: SparkSession, path: str) -> dict | None:
    """What is known about the run in a folder; None if it has no rows."""
    found = flush.run_properties(read_run(spark, path, 0)).drop("run_id").first()
    if found is None:
        return None
    return {k: v.hex() if isinstance(v, (bytes, bytearray)) else v for k, v in found.asDict().items()}


def read_run(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    plain = log.schema().fieldNames()[:6]
    return spark.read.schema(log.schema()).parquet(path).select(*plain, F.lit(None).cast("int").alias("layer"), F.lit(run_id).cast("long").alias("run_id"))


def may_hold(properties: dict, start: bytes, end: bytes | None) -> bool:
    """Whether a run can bear on keys in [start, end): by its points' keys, or by its range deletes, which reach further."""
    lo, hi, first, last = (bytes.fromhex(v) if v else None for v in (properties[k] for k in ("min_key", "max_key", "min_range_start", "max_range_end")))
    points = lo is not None and hi >= start and (end is None or lo < end)
    ranges = first is not None and last > start and (end is None or first < end)
    return points or ranges
