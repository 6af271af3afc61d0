"""The manifest: a log of metadata events, folded to the state it describes.

Events are rows (seq, type, id, last_lsn, added, removed). The fold is idempotent: of the events about one id the last counts,
so a record that is replayed twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_number


def state(events: DataFrame) -> DataFrame:
    """kind (sst, frozen_wal, active_wal, last_lsn) and id."""
    one = lambda type_, there: events.where(F.col("type") == type_).select("seq", "id", F.lit(there).alias("there"))
    many = lambda c, there: events.where(F.col("type") == "Compaction").select("seq", F.explode(c).alias("id"), F.lit(there).alias("there"))
    ssts = one("AddSst", True).union(one("RemoveSst", False)).union(many("added", True)).union(many("removed", False))
    wals = one("AddFrozenWal", True).union(one("RemoveFrozenWal", False))
    last = lambda rows: rows.groupBy("id").agg(F.max_by("there", "seq").alias("there")).where("there")
    return (
        last(ssts).select(F.lit("sst").alias("kind"), "id")
        .union(last(wals).select(F.lit("frozen_wal"), "id"))
        .union(events.where(F.col("type") == "SetActiveWal").agg(F.max_by("id", "seq").alias("id")).where("id is not null").select(F.lit("active_wal"), "id"))
        .union(events.agg(F.max("last_lsn").alias("id")).where("id is not null").select(F.lit("last_lsn"), "id"))
    )


def reconciled_lsn(events: DataFrame, log: DataFrame) -> DataFrame:
    """last_lsn: the greatest that the manifest, a batch or a run knows of."""
    return events.select("last_lsn").union(log.select("lsn")).agg(F.coalesce(F.max("last_lsn"), F.lit(0)).alias("last_lsn"))


def orphans(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of run files that the manifest doesn't hold. They are reported and never deleted here."""
    ssts = known.where("kind = 'sst'").select(F.col("id").alias("_id"))
    return listed.withColumn("_n", file_number(F.col("path"))).where(F.col("_n").isNotNull()).join(ssts, F.col("_n") == F.col("_id"), "left_anti").select("path")


def valid_prefix(rows: DataFrame, seq: str, valid: Column) -> DataFrame:
    """The rows before the first, in the order of seq, that isn't valid."""
    bad = rows.where(~valid | valid.isNull()).agg(F.min(seq).alias("bad")).scalar()
    return rows.where(bad.isNull() | (F.col(seq) < bad))
