"""Point lookups, key-range scans and merges. Bounds go to both kinds of record: points by key, range deletes by overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import successor
from .log import RANGE_DELETE, record_order
from .resolve import outcome, visible


def within(log: DataFrame, start, end=None) -> DataFrame:
    """The records that bear on keys in [start, end); end None: no upper bound. The bounds reach the Parquet scan."""
    point, tomb = F.col("key") >= F.lit(start), F.col("end") > F.lit(start)
    if end is not None:
        point, tomb = point & (F.col("key") < F.lit(end)), tomb & (F.col("key") < F.lit(end))
    return log.where((F.col("op") < RANGE_DELETE) & point | (F.col("op") == RANGE_DELETE) & tomb)


def raw_scan(log: DataFrame, start, end) -> DataFrame:
    """All versions in [start, end) and every overlapping range delete, in record order."""
    return within(log, start, end).orderBy(*record_order())


def scan(log: DataFrame, start, end) -> DataFrame:
    """key and value of the live keys in [start, end), ascending; none if start >= end. Empty bounds are an error."""
    if not start or not end:
        raise ValueError("scan bounds must not be empty")
    return visible(within(log, start, end)).where((F.col("key") >= F.lit(start)) & (F.col("key") < F.lit(end))).select("key", "value").orderBy("key")


def prefix_scan(log: DataFrame, prefix) -> DataFrame:
    """key and value of the live keys that start with prefix, ascending."""
    if not prefix:
        raise ValueError("a prefix must not be empty")
    return visible(within(log, prefix, successor(prefix))).where(F.startswith("key", F.lit(prefix))).select("key", "value").orderBy("key")


def multi_get(keys: DataFrame, log: DataFrame) -> DataFrame:
    """key and value for each distinct key asked for; null where it isn't live. One plan for any number of keys."""
    return outcome(keys, log).select("key", "value")


def merge(*layers: DataFrame) -> DataFrame:
    """The records of several layers or runs in one record order."""
    return reduce(DataFrame.unionByName, layers).orderBy(*record_order())
