"""What is visible: a key's newest point must be a put, and no newer range delete may cover it.

Range deletes meet keys by the sweep of ``sweep``: no pair is compared, whatever overlaps, and nothing runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import DELETE, PUT, points, ranges
from .sweep import stabbed


def latest(rows: DataFrame) -> DataFrame:
    """The newest point of each key. Copies of one (key, lsn) in several layers count once."""
    fields = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*fields), F.struct("lsn", F.coalesce("ts", F.lit(0)))).alias("_r")).select("key", "_r.*")


def _newest_first(tombs: DataFrame) -> DataFrame:
    """Range deletes as spans whose least value is the greatest lsn."""
    return tombs.select("start", "end", (-F.col("lsn")).alias("value"), F.lit(0).cast("long").alias("run"))


def uncovered(rows: DataFrame, tombs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The rows (key, lsn, ...) that no newer range delete (start, end, lsn) covers. keys (key, ...): where the cuts of the key space are sampled, if not from both."""
    return stabbed(rows, _newest_first(tombs), keys).where(F.col("v1").isNull() | (-F.col("v1") <= F.col("lsn"))).select(*rows.columns)


def covering(keys: DataFrame, tombs: DataFrame) -> DataFrame:
    """key and covering_lsn, the newest range delete over it, for the distinct keys (key) that have one."""
    keys = keys.select("key").distinct()
    return stabbed(keys, _newest_first(tombs)).where("v1 is not null").select("key", (-F.col("v1")).alias("covering_lsn"))


def visible(log: DataFrame) -> DataFrame:
    """key, value, lsn of the visible state of a log. Filters on value or op belong after this, never before."""
    live = latest(points(log).select("key", "op", "value", "lsn", "ts")).where(F.col("op") == PUT)
    return uncovered(live, ranges(log), log.select("key", "lsn")).select("key", "value", "lsn")


def outcome(keys: DataFrame, log: DataFrame) -> DataFrame:
    """key, outcome (Put, Delete, RangeDelete, NotFound), value and lsn for each distinct key asked for."""
    keys = keys.select("key").distinct()
    own = latest(points(log).join(keys, "key", "left_semi").select("key", "op", "value", "lsn", "ts"))
    both = keys.join(own, "key", "left").join(covering(keys, ranges(log)), "key", "left")
    ranged = F.col("covering_lsn").isNotNull() & (F.col("lsn").isNull() | (F.col("covering_lsn") > F.col("lsn")))
    name = F.when(ranged, "RangeDelete").when(F.col("op") == PUT, "Put").when(F.col("op") == DELETE, "Delete").otherwise("NotFound")
    return both.select("key", name.alias("outcome"), F.when(~ranged & (F.col("op") == PUT), F.col("value")).alias("value"), F.when(ranged, F.col("covering_lsn")).otherwise(F.col("lsn")).alias("lsn"))
