"""The engine's queries over the driver's tables, and their SQL. Names begin with the inventory ids they cover first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import compact, flush, log, resolve, scan
from ..sources import manifest
from ..sources.events import customer_keys, event_log, layered_log
from . import workloads

Query = Callable[[SparkSession, str], DataFrame]
LOW, HIGH, PREFIX = "u000010", "u000030", "u000042/"
NOW = 1_704_500_000_123_456_789
BUDGET, RATIO, TIERING = 4096, 0.1, compact.Tiering(low=0.9, high=1.1, small=17000, least=4, most=32)

LOG = """
src AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '/' AS u FROM events),
ops AS (SELECT *, CASE WHEN event_type = 'error' AND k >= 80 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END AS op FROM src),
log AS (SELECT op,
  CASE WHEN op = 2 THEN u || lpad(CAST((k - 80) * 5 AS VARCHAR), 3, '0') ELSE u || lpad(CAST(k AS VARCHAR), 3, '0') END AS key,
  CASE WHEN op = 2 THEN u || lpad(CAST((k - 80) * 5 + 25 AS VARCHAR), 3, '0') END AS e,
  CASE WHEN op = 0 THEN value END AS value, event_id + 1 AS lsn, epoch_us(ts) * 1000 AS ts, event_id // 500 AS run_id,
  CASE WHEN event_id // 500 = (SELECT max(event_id // 500) FROM events) THEN 0 WHEN event_id // 500 >= (SELECT max(event_id // 500) - 2 FROM events) THEN 1 ELSE 2 END AS layer FROM ops),
pts AS (SELECT * FROM log WHERE op < 2),
rts AS (SELECT key AS s, e, lsn, run_id, layer FROM log WHERE op = 2),
newest AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1),
live AS (SELECT key, value, lsn FROM newest n WHERE op = 0 AND NOT EXISTS (SELECT 1 FROM rts WHERE n.key >= s AND n.key < rts.e AND rts.lsn > n.lsn)),
cover AS (SELECT k.key, max(r.lsn) AS covering_lsn FROM (SELECT DISTINCT key FROM log) k JOIN rts r ON k.key >= r.s AND k.key < r.e GROUP BY k.key)
"""
SIZE = "24 + strlen(key) + coalesce(strlen(e), 0) + coalesce(length(CAST(CAST(lsn AS DOUBLE) AS VARCHAR)) * 0 + 8, 0) * CASE WHEN op = 0 THEN 1 ELSE 0 END"
PROPS = f"""
props AS (SELECT run_id, count(*) FILTER (WHERE op < 2) AS record_count, count(*) FILTER (WHERE op = 1) AS tombstone_count, count(*) FILTER (WHERE op = 2) AS range_tombstone_count,
  min(lsn) AS min_lsn, max(lsn) AS max_lsn, min(ts) AS min_ts, max(ts) AS max_ts, min(key) FILTER (WHERE op < 2) AS min_key, max(key) FILTER (WHERE op < 2) AS max_key,
  min(key) FILTER (WHERE op = 2) AS min_range_start, max(e) FILTER (WHERE op = 2) AS max_range_end, CAST(sum({SIZE}) AS BIGINT) AS file_size FROM log GROUP BY run_id)
"""
OUTCOME = """
asked AS (SELECT DISTINCT key FROM {keys}),
told AS (SELECT a.key, n.op, n.value, n.lsn, c.covering_lsn, c.covering_lsn IS NOT NULL AND (n.lsn IS NULL OR c.covering_lsn > n.lsn) AS ranged
  FROM asked a LEFT JOIN newest n ON a.key = n.key LEFT JOIN (SELECT a.key, max(r.lsn) AS covering_lsn FROM asked a JOIN rts r ON a.key >= r.s AND a.key < r.e GROUP BY a.key) c ON a.key = c.key),
outcomes AS (SELECT key, CASE WHEN ranged THEN 'RangeDelete' WHEN op = 0 THEN 'Put' WHEN op = 1 THEN 'Delete' ELSE 'NotFound' END AS outcome, CASE WHEN NOT ranged AND op = 0 THEN value END AS value, CASE WHEN ranged THEN covering_lsn ELSE lsn END AS lsn FROM told)
"""


def sized(rows: DataFrame) -> DataFrame:
    """The log with values as 8 bytes, so that sizes don't depend on how a double is printed."""
    return rows.withColumn("value", F.when(F.col("value").isNotNull(), F.lit("8 bytes.")))


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return flush.run_properties(sized(event_log(spark, d)))


def visible_state(spark: SparkSession, d: str) -> DataFrame:
    return resolve.visible(event_log(spark, d))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return resolve.latest(log.points(event_log(spark, d)).select("key", "op", "value", "lsn", "ts"))


def get_outcome(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    out = resolve.outcome(rows.select("key").union(spark.createDataFrame([("u999999/000",)], "key string")), rows)
    return out.withColumn("lsn", F.coalesce("lsn", F.lit(0)))


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return scan.multi_get(customer_keys(spark, d), event_log(spark, d))


def point_get(spark: SparkSession, d: str) -> DataFrame:
    """One key, filtered before anything else."""
    rows = event_log(spark, d, (PREFIX, PREFIX))
    asked = spark.createDataFrame([(PREFIX + "007",)], "key string")
    return scan.multi_get(asked, scan.within(rows, PREFIX + "007", keys.successor(PREFIX + "007")))


def scan_range(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(event_log(spark, d, (LOW, HIGH)), LOW, HIGH)


def scan_prefix(spark: SparkSession, d: str) -> DataFrame:
    return scan.prefix_scan(event_log(spark, d, (PREFIX, PREFIX)), PREFIX)


def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.raw_scan(event_log(spark, d, (LOW, HIGH)), LOW, HIGH).select("op", "key", "end", "value", "lsn")


def covering_tombstone(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    return resolve.covering(rows, log.ranges(rows))


def merge_layers(spark: SparkSession, d: str) -> DataFrame:
    rows = layered_log(spark, d)
    return scan.merge(*(rows.where(F.col("layer") == i) for i in range(3))).select("key", "op", "lsn", "layer")


def range_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return log.ranges(event_log(spark, d)).select("start", "end", "lsn", "run_id")


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """orders as a batch of puts after lsn 1000, numbered by key."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return log.numbered(orders, 1000, ["o_orderkey"]).select("o_orderkey", "lsn")


def freeze_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return flush.sealed(sized(event_log(spark, d)), BUDGET).select("batch", "start_lsn", "end_lsn", "n", "bytes")


def flush_entries(spark: SparkSession, d: str) -> DataFrame:
    return flush.flush_entries(layered_log(spark, d).where("layer = 1")).select("op", "key", "end", "value", "lsn")


def run_properties(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(spark, d)


def engine_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = sized(layered_log(spark, d))
    frozen = rows.where("layer = 1").agg(F.count_distinct("run_id").alias("n")).scalar()
    out = flush.engine_stats(flush.run_properties(rows.where("layer = 2")), frozen)
    return out.withColumn("sizes", F.array_join("sizes", ","))


def memtable_stats(spark: SparkSession, d: str) -> DataFrame:
    return flush.memtable_stats(sized(layered_log(spark, d)).where("layer = 0"))


def size_tiers(spark: SparkSession, d: str) -> DataFrame:
    return compact.tier_table(runs_of(spark, d), TIERING)


def minor_compact(spark: SparkSession, d: str) -> DataFrame:
    return compact.minor(event_log(spark, d).where("run_id < 4")).select("op", "key", "end", "value", "lsn")


def minor_then_visible(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    own = ["op", "key", "end", "value", "lsn", "ts"]
    return resolve.visible(compact.minor(rows.where("run_id < 4")).select(own).union(rows.where("run_id >= 4").select(own)))


def major_compact(spark: SparkSession, d: str) -> DataFrame:
    return compact.major(event_log(spark, d)).select("op", "key", "value", "lsn")


def tombstone_candidate(spark: SparkSession, d: str) -> DataFrame:
    return compact.tombstone_candidate(runs_of(spark, d), RATIO)


def droppable_points(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    return compact.droppable_points(rows, rows).select("key", "lsn")


def droppable_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    return compact.droppable_ranges(rows, rows).select("start", "end", "lsn")


def gc_then_visible(spark: SparkSession, d: str) -> DataFrame:
    """The newest quarter of the runs rewritten without the deletes that hide nothing, then the visible state."""
    rows = event_log(spark, d)
    own = ["op", "key", "end", "value", "lsn", "ts"]
    return resolve.visible(compact.tombstone_gc(rows.where("run_id % 4 = 3"), rows).select(own).union(rows.where("run_id % 4 <> 3").select(own)))


def overlapping_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = event_log(spark, d)
    return compact.overlap_counts(rows, flush.run_properties(rows))


def manifest_events(spark: SparkSession, d: str) -> DataFrame:
    """A manifest log over the event runs: each run's log is frozen, flushed and dropped; each fourth run merges the last four."""
    runs = event_log(spark, d).groupBy("run_id").agg(F.max("lsn").alias("last"))
    kinds = [
        F.struct((F.col("run_id") * 10).alias("seq"), F.lit("SetActiveWal").alias("type"), F.col("run_id").alias("id"), F.lit(None).cast("long").alias("last_lsn")),
        F.struct((F.col("run_id") * 10 + 1).alias("seq"), F.lit("AddFrozenWal").alias("type"), F.col("run_id").alias("id"), F.lit(None).cast("long").alias("last_lsn")),
        F.struct((F.col("run_id") * 10 + 2).alias("seq"), F.lit("AddSst").alias("type"), F.col("run_id").alias("id"), F.lit(None).cast("long").alias("last_lsn")),
        F.struct((F.col("run_id") * 10 + 3).alias("seq"), F.lit("RemoveFrozenWal").alias("type"), F.when(F.col("run_id") % 5 != 4, F.col("run_id")).otherwise(-1).alias("id"), F.lit(None).cast("long").alias("last_lsn")),
        F.struct((F.col("run_id") * 10 + 4).alias("seq"), F.lit("UpdateLsn").alias("type"), F.lit(None).cast("long").alias("id"), F.col("last").alias("last_lsn")),
    ]
    base = runs.select(F.explode(F.array(*kinds)).alias("x")).select("x.*").select("seq", "type", "id", "last_lsn", F.lit(None).cast("array<bigint>").alias("added"), F.lit(None).cast("array<bigint>").alias("removed"))
    merges = runs.where("run_id % 4 = 3").select((F.col("run_id") * 10 + 5).alias("seq"), F.lit("Compaction").alias("type"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("last_lsn"), F.array(F.col("run_id") + 100_000).alias("added"), F.sequence(F.col("run_id") - 3, F.col("run_id")).alias("removed"))
    return base.union(merges)


def manifest_state(spark: SparkSession, d: str) -> DataFrame:
    return manifest.state(manifest_events(spark, d))


def lsn_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return manifest.reconciled_lsn(manifest_events(spark, d), event_log(spark, d))


def orphan_runs(spark: SparkSession, d: str) -> DataFrame:
    listed = event_log(spark, d).select(keys.file_name(F.col("run_id"), ".sst").alias("path")).distinct()
    return manifest.orphans(listed, manifest_state(spark, d))


def crc_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Records up to the first whose checksum is wrong; every 3001st is made so."""
    rows = event_log(spark, d).select("lsn", "key", keys.checksum(F.col("lsn"), F.col("key")).alias("crc"))
    return manifest.valid_prefix(rows.withColumn("crc", F.when(F.col("lsn") % 3001 == 0, F.col("crc") + 1).otherwise(F.col("crc"))), "lsn", F.col("crc") == keys.checksum(F.col("lsn"), F.col("key"))).select("lsn", "key")


def scalars(spark: SparkSession, d: str) -> DataFrame:
    """Keys as messages show them, times in seconds, and ages at NOW, before which some of the log lies and some after."""
    rows = event_log(spark, d)
    at = F.lit(NOW).cast("long")
    path = keys.file_name(F.col("run_id"), ".sst")
    return rows.select("lsn", keys.shown(F.col("key"), 8).alias("shown"), keys.seconds(F.col("ts")).alias("seconds"), keys.age_seconds(at, F.col("ts")).alias("age"), keys.file_number(path).alias("number"))


QUERIES: dict[str, Query] = {
    "a7_visible_state": visible_state,
    "r15_latest_version": latest_version,
    "r1_get_outcome": get_outcome,
    "a6_point_get": point_get,
    "a6_multi_get": multi_get,
    "a7_scan_range": scan_range,
    "r18_scan_prefix": scan_prefix,
    "r11_raw_scan": raw_scan,
    "r5_covering_tombstone": covering_tombstone,
    "r13_merge_layers": merge_layers,
    "r17_range_tombstones": range_tombstones,
    "w3_numbered": numbered,
    "w6_freeze_boundaries": freeze_boundaries,
    "w7_flush_entries": flush_entries,
    "w10_run_properties": run_properties,
    "m14_engine_stats": engine_stats,
    "m15_memtable_stats": memtable_stats,
    "c1_size_tiers": size_tiers,
    "c3_minor_compact": minor_compact,
    "c5_minor_then_visible": minor_then_visible,
    "c6_major_compact": major_compact,
    "c8_tombstone_candidate": tombstone_candidate,
    "c9_droppable_points": droppable_points,
    "c10_droppable_ranges": droppable_ranges,
    "c12_gc_then_visible": gc_then_visible,
    "c10_overlapping_runs": overlapping_runs,
    "m1_manifest_state": manifest_state,
    "m8_lsn_reconcile": lsn_reconcile,
    "m9_orphan_runs": orphan_runs,
    "m11_crc_prefix": crc_prefix,
    "s28_scalars": scalars,
    **workloads.QUERIES,
}

MANIFEST = """
r AS (SELECT run_id, max(lsn) AS last FROM log GROUP BY run_id),
ssts AS (SELECT run_id * 10 + 2 AS seq, run_id AS id, true AS there FROM r
  UNION ALL SELECT run_id * 10 + 5, run_id + 100000, true FROM r WHERE run_id % 4 = 3
  UNION ALL SELECT run_id * 10 + 5, run_id - x, false FROM r, (SELECT unnest([0, 1, 2, 3]) AS x) WHERE run_id % 4 = 3),
wals AS (SELECT run_id * 10 + 1 AS seq, run_id AS id, true AS there FROM r UNION ALL SELECT run_id * 10 + 3, run_id, false FROM r WHERE run_id % 5 <> 4),
state AS (SELECT 'sst' AS kind, id FROM (SELECT id, arg_max(there, seq) AS there FROM ssts GROUP BY id) WHERE there
  UNION ALL SELECT 'frozen_wal', id FROM (SELECT id, arg_max(there, seq) AS there FROM wals GROUP BY id) WHERE there
  UNION ALL SELECT 'active_wal', max(run_id) FROM r UNION ALL SELECT 'last_lsn', max(last) FROM r)
"""

SQL: dict[str, str] = {
    "a7_visible_state": f"WITH {LOG} SELECT key, value, lsn FROM live",
    "r15_latest_version": f"WITH {LOG} SELECT key, op, value, lsn, ts FROM newest",
    "r1_get_outcome": f"WITH {LOG}, {OUTCOME.format(keys="(SELECT key FROM log UNION ALL SELECT 'u999999/000')")} SELECT key, outcome, value, coalesce(lsn, 0) AS lsn FROM outcomes",
    "a6_point_get": f"WITH {LOG}, {OUTCOME.format(keys=f"(SELECT '{PREFIX}007' AS key)")} SELECT key, value FROM outcomes",
    "a6_multi_get": f"WITH {LOG}, ck AS (SELECT 'u' || lpad(CAST(c_custkey % 150 AS VARCHAR), 6, '0') || '/' || lpad(CAST((c_custkey * 7) % 100 AS VARCHAR), 3, '0') AS key FROM customer), {OUTCOME.format(keys='ck')} SELECT key, value FROM outcomes",
    "a7_scan_range": f"WITH {LOG} SELECT key, value FROM live WHERE key >= '{LOW}' AND key < '{HIGH}'",
    "r18_scan_prefix": f"WITH {LOG} SELECT key, value FROM live WHERE starts_with(key, '{PREFIX}')",
    "r11_raw_scan": f"WITH {LOG} SELECT op, key, e AS \"end\", value, lsn FROM log WHERE (op < 2 AND key >= '{LOW}' AND key < '{HIGH}') OR (op = 2 AND e > '{LOW}' AND key < '{HIGH}')",
    "r5_covering_tombstone": f"WITH {LOG} SELECT key, covering_lsn FROM cover",
    "r13_merge_layers": f"WITH {LOG} SELECT key, op, lsn, layer FROM log",
    "r17_range_tombstones": f"WITH {LOG} SELECT s AS start, e AS \"end\", lsn, run_id FROM rts",
    "w3_numbered": "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS lsn FROM orders",
    "w6_freeze_boundaries": f"""WITH RECURSIVE {LOG}, s AS (SELECT lsn, CAST({SIZE} AS BIGINT) AS size, row_number() OVER (ORDER BY lsn) AS i FROM log),
  fold AS (SELECT i, lsn, size, CAST(0 AS BIGINT) AS batch, size AS have FROM s WHERE i = 1
    UNION ALL SELECT s.i, s.lsn, s.size, CASE WHEN f.have + s.size <= {BUDGET} THEN f.batch ELSE f.batch + 1 END, CASE WHEN f.have + s.size <= {BUDGET} THEN f.have + s.size ELSE s.size END FROM fold f JOIN s ON s.i = f.i + 1)
  SELECT batch, min(lsn) AS start_lsn, max(lsn) AS end_lsn, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fold GROUP BY batch""",
    "w7_flush_entries": f"WITH {LOG}, own AS (SELECT * FROM pts WHERE layer = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) SELECT op, key, e AS \"end\", value, lsn FROM own UNION ALL SELECT op, key, e, value, lsn FROM log WHERE layer = 1 AND op = 2",
    "w10_run_properties": f"WITH {LOG}, {PROPS} SELECT * FROM props",
    "m14_engine_stats": f"WITH {LOG}, {PROPS}, own AS (SELECT * FROM props WHERE run_id IN (SELECT run_id FROM log WHERE layer = 2)) SELECT (SELECT count(DISTINCT run_id) FROM log WHERE layer = 1) AS frozen_count, count(*) AS run_count, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, coalesce(string_agg(CAST(file_size AS VARCHAR), ',' ORDER BY max_lsn DESC), '') AS sizes FROM own",
    "m15_memtable_stats": f"WITH {LOG} SELECT CAST(sum({SIZE}) AS BIGINT) AS size, count(DISTINCT key) FILTER (WHERE op < 2) AS distinct_keys, count(*) FILTER (WHERE op < 2) AS versions, count(*) FILTER (WHERE op = 1) AS tombstones, count(*) FILTER (WHERE op = 2) AS range_tombstones FROM log WHERE layer = 0",
    "c1_size_tiers": f"""WITH RECURSIVE {LOG}, {PROPS}, o AS (SELECT run_id, file_size, row_number() OVER (ORDER BY file_size, run_id) AS i FROM props),
  fold AS (SELECT i, run_id, file_size < {TIERING.small} AS small, CAST(0 AS BIGINT) AS tier, CAST(1 AS BIGINT) AS n, file_size AS total FROM o WHERE i = 1
    UNION ALL SELECT i, run_id, small, CASE WHEN same THEN tier ELSE tier + 1 END, CASE WHEN same THEN n + 1 ELSE 1 END, CASE WHEN same THEN total + file_size ELSE file_size END FROM (
      SELECT o.i, o.run_id, o.file_size, o.file_size < {TIERING.small} AS small, f.tier, f.n, f.total,
        CASE WHEN o.file_size < {TIERING.small} OR f.small THEN o.file_size < {TIERING.small} AND f.small ELSE o.file_size >= CAST(f.total AS DOUBLE) / f.n * {TIERING.low}::DOUBLE AND o.file_size <= CAST(f.total AS DOUBLE) / f.n * {TIERING.high}::DOUBLE END AS same
      FROM fold f JOIN o ON o.i = f.i + 1))
  SELECT run_id, tier FROM fold""",
    "c3_minor_compact": f"WITH {LOG}, own AS (SELECT * FROM pts WHERE run_id < 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) SELECT op, key, e AS \"end\", value, lsn FROM own UNION ALL SELECT op, key, e, value, lsn FROM log WHERE run_id < 4 AND op = 2",
    "c5_minor_then_visible": f"WITH {LOG} SELECT key, value, lsn FROM live",
    "c6_major_compact": f"WITH {LOG} SELECT 0 AS op, key, value, lsn FROM live",
    "c8_tombstone_candidate": f"WITH {LOG}, {PROPS} SELECT run_id, ratio FROM (SELECT run_id, CAST(tombstone_count + range_tombstone_count AS DOUBLE) / greatest(record_count, 1) AS ratio FROM props) WHERE ratio >= {RATIO} ORDER BY ratio DESC, run_id LIMIT 1",
    "c9_droppable_points": f"WITH {LOG} SELECT key, lsn FROM pts t WHERE op = 1 AND NOT EXISTS (SELECT 1 FROM pts p WHERE p.key = t.key AND p.lsn < t.lsn AND p.run_id <> t.run_id) AND NOT EXISTS (SELECT 1 FROM rts r WHERE t.key >= r.s AND t.key < r.e AND r.lsn < t.lsn AND r.run_id <> t.run_id)",
    "c10_droppable_ranges": f"WITH {LOG} SELECT s AS start, e AS \"end\", lsn FROM rts t WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.key >= t.s AND p.key < t.e AND p.lsn < t.lsn AND (p.run_id <> t.run_id OR p.op = 0))",
    "c12_gc_then_visible": f"WITH {LOG} SELECT key, value, lsn FROM live",
    "c10_overlapping_runs": f"WITH {LOG}, {PROPS} SELECT p.run_id AS older_run, count(*) AS n FROM rts t JOIN props p ON p.run_id <> t.run_id AND p.min_key < t.e AND p.max_key >= t.s AND p.min_lsn < t.lsn GROUP BY p.run_id",
    "m1_manifest_state": f"WITH {LOG}, {MANIFEST} SELECT * FROM state",
    "m8_lsn_reconcile": f"WITH {LOG} SELECT max(lsn) AS last_lsn FROM log",
    "m9_orphan_runs": f"WITH {LOG}, {MANIFEST} SELECT DISTINCT lpad(CAST(run_id AS VARCHAR), 6, '0') || '.sst' AS path FROM log WHERE run_id NOT IN (SELECT id FROM state WHERE kind = 'sst')",
    "m11_crc_prefix": f"WITH {LOG} SELECT lsn, key FROM log WHERE lsn < 3001",
    "s28_scalars": f"""WITH {LOG} SELECT lsn, lower(hex(encode(substr(key, 1, 8)))) || '...' AS shown, ts // 1000000000 AS seconds,
    greatest(0, {NOW} // 1000000000 - ts // 1000000000) AS age, run_id AS number FROM log""",
    **workloads.SQL,
}
