"""Queries that go through a store: its writes, reads, merges, versions and recovery, over whole tables, and their SQL.

The event log is written in BATCHES parts of equal length, each as one run. Writing is eager; what is returned reads the runs lazily.
Only the 25 nations are written change by change. Stores lie in the shared folder and go when the driver ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log, resolve, scan
from ..sources.events import as_log, customer_keys, event_log
from ..sources.files import Files, scratch
from ..streaming.ingest import ingest
from .db import Db, DbConfig
from .queries import HIGH, LOG, LOW, OUTCOME

Query = Callable[[SparkSession, str], DataFrame]
BATCHES = 4
#: Range of nations that is deleted, and a key that no nation has.
START, END, ABSENT = b"I", b"K", b"ATLANTIS"


def records(rows: DataFrame) -> DataFrame:
    """A log's rows as a store takes them; at: their order. The value of a put tells its number."""
    value = F.when(F.col("op") == log.PUT, F.concat(F.lit("v"), F.col("lsn").cast("string")))
    return rows.select("op", F.col("key").cast("binary").alias("key"), F.col("end").cast("binary").alias("end"), value.cast("binary").alias("value"), F.col("lsn").alias("at"))


def filled(spark: SparkSession, d: str, config: DbConfig | None = None) -> Db:
    """A store with the whole event log."""
    db, rows = Db.open(spark, scratch(spark), config), records(event_log(spark, d))
    total = rows.count()
    for i in range(BATCHES):
        db.write(rows.where(F.col("at").between(total * i // BATCHES + 1, total * (i + 1) // BATCHES)), ["at"])
    return db


def shown(rows: DataFrame) -> DataFrame:
    """Binary columns as text."""
    return rows.select(*(F.decode(c, "UTF-8").alias(c) if c in ("key", "end", "value") else F.col(c) for c in rows.columns))


def reopened(spark: SparkSession, d: str) -> DataFrame:
    """The visible state after the store was closed and opened again."""
    with filled(spark, d) as db:
        path = db._files.url("").rstrip("/")
    with Db.open(spark, path) as db:
        return shown(resolve.visible(db.snapshot()).select("key", "value", "lsn"))


def scanned(spark: SparkSession, d: str) -> DataFrame:
    with filled(spark, d) as db:
        return shown(db.scan_frame(LOW.encode(), HIGH.encode()))


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    with filled(spark, d) as db:
        return shown(db.multi_get(customer_keys(spark, d).select(F.col("key").cast("binary").alias("key"))))


def raw(spark: SparkSession, d: str) -> DataFrame:
    with filled(spark, d) as db:
        return shown(scan.raw_scan(db.snapshot(), bytearray(LOW.encode()), bytearray(HIGH.encode())).select("op", "key", "end", "value", "lsn"))


def run_table(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest says of each run."""
    with filled(spark, d) as db:
        names = ("id", "record_count", "tombstone_count", "range_tombstone_count", "min_lsn", "max_lsn")
        rows = [tuple(r[n] for n in names) + tuple(bytes.fromhex(r[n]).decode() for n in ("min_key", "max_key")) for r in db._now()[0].runs]
    kinds = ", ".join(f"{n} long" for n in names)
    return spark.createDataFrame(rows, f"{kinds}, min_key string, max_key string")


def merged(spark: SparkSession, d: str) -> DataFrame:
    """The records of the run that the store's strategy makes of runs of like size."""
    with filled(spark, d) as db:
        assert db.minor_compact() and db.stats()["run_count"] == 1
        return shown(db.snapshot().select("op", "key", "end", "value", "lsn"))


def collected(spark: SparkSession, d: str) -> DataFrame:
    """The visible state once the deletes that hide nothing have gone from the run with most of them."""
    with filled(spark, d, DbConfig(tombstone_compaction_ratio=0.01)) as db:
        db.tombstone_compact()
        return shown(resolve.visible(db.snapshot()).select("key", "value", "lsn"))


def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The records that are left of a full merge, which leaves one run."""
    with filled(spark, d) as db:
        assert db.major_compact() and db.stats()["run_count"] == 1
        return shown(db.snapshot().select("op", "key", "value", "lsn"))


def earlier(spark: SparkSession, d: str) -> DataFrame:
    """The visible state of the version that named half of the log, read after a full merge and a vacuum that keeps it."""
    with filled(spark, d) as db:
        db.major_compact()
        db.vacuum(keep_versions=BATCHES)
        return shown(resolve.visible(db.snapshot(BATCHES // 2)).select("key", "value", "lsn"))


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """The visible state of a store whose newest manifest version is spoiled and whose write-ahead file is torn, opened again."""
    with filled(spark, d) as db:
        files: Files = db._files
        newest, last = f"manifest/{db._now()[0].number:020d}.json", db._lsn
    files.delete(newest)
    files.create(newest, "{}\n0")
    files.create(f"wal/{last + 1:020d}-{last + 1:020d}.json", "[0, \t0")
    with Db.open(spark, files.url("").rstrip("/")) as db:
        assert len(db.skipped) == 2
        return shown(resolve.visible(db.snapshot()).select("key", "value", "lsn"))


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The visible state after the events came as a stream."""
    events = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(events).parquet(f"{d}/events.parque[t]")  # a pattern may name a single file
    path = scratch(spark)
    with Db.open(spark, path) as db:
        query = ingest(records(as_log(stream)), db, ["at"], f"{path}-stream", f"ingest-{path[-8:]}")
        query.awaitTermination()
        Files(spark, f"{path}-stream").delete("")
        return shown(resolve.visible(db.snapshot()).select("key", "value", "lsn"))


def one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """The nations put, some of them deleted by key and by range, every fifth put again; buffers are flushed on the way. Then each is asked for."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows by definition
    path, small = scratch(spark), DbConfig(write_buffer_size=1024)
    with Db.open(spark, path, small) as db:
        for n in nations:
            db.put(n.n_name.encode(), f"nation {n.n_nationkey}".encode())
        for n in nations:
            if n.n_regionkey == 0:
                db.delete(n.n_name.encode())
        db.delete_range(START, END)
        db.apply([("put", n.n_name.encode(), b"again") for n in nations if n.n_nationkey % 5 == 0])
        db.wait()
        assert db.stats()["run_count"]
    with Db.open(spark, path, small) as db:
        found = [(key.decode(), (value := db.get(key)) and value.decode()) for key in (*(n.n_name.encode() for n in nations), ABSENT)]
    return spark.createDataFrame(found, "key string, value string")


QUERIES: dict[str, Query] = {
    "a1_store_reopened": reopened,
    "a3_store_one_by_one": one_by_one,
    "a6_store_multi_get": looked_up,
    "a7_store_scan": scanned,
    "a8_store_major": compacted,
    "a11_store_streamed": streamed,
    "c2_store_minor": merged,
    "c12_store_collected": collected,
    "m4_store_version": earlier,
    "m6_store_recovered": recovered,
    "r10_store_raw_scan": raw,
    "w9_store_runs": run_table,
}
LIVE = f"WITH {LOG} SELECT key, 'v' || lsn AS value, lsn FROM live"
CUSTOMERS = "ck AS (SELECT 'u' || lpad(CAST(c_custkey % 150 AS VARCHAR), 6, '0') || '/' || lpad(CAST((c_custkey * 7) % 100 AS VARCHAR), 3, '0') AS key FROM customer)"
PUT = "CASE WHEN op = 0 THEN 'v' || lsn END AS value"
SQL: dict[str, str] = {
    "a1_store_reopened": LIVE,
    "a3_store_one_by_one": f"""SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN 'again'
    WHEN n_regionkey = 0 OR n_name >= '{START.decode()}' AND n_name < '{END.decode()}' THEN NULL ELSE 'nation ' || n_nationkey END AS value FROM nation
  UNION ALL SELECT '{ABSENT.decode()}', NULL""",
    "a6_store_multi_get": f"WITH {LOG}, {CUSTOMERS}, {OUTCOME.format(keys='ck')} SELECT key, CASE WHEN value IS NOT NULL THEN 'v' || lsn END AS value FROM outcomes",
    "a7_store_scan": f"WITH {LOG} SELECT key, 'v' || lsn AS value FROM live WHERE key >= '{LOW}' AND key < '{HIGH}'",
    "a8_store_major": f"WITH {LOG} SELECT 0 AS op, key, 'v' || lsn AS value, lsn FROM live",
    "a11_store_streamed": LIVE,
    "c2_store_minor": f"""WITH {LOG} SELECT op, key, e AS "end", {PUT}, lsn FROM log WHERE op = 2 OR lsn IN (SELECT lsn FROM newest)""",
    "c12_store_collected": LIVE,
    "m4_store_version": f"""WITH {LOG}, half AS (SELECT * FROM log WHERE lsn <= (SELECT count(*) FROM log) * {BATCHES // 2} // {BATCHES}),
  last AS (SELECT * FROM half WHERE op < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)
  SELECT key, 'v' || lsn AS value, lsn FROM last n WHERE op = 0 AND NOT EXISTS (SELECT 1 FROM half r WHERE r.op = 2 AND n.key >= r.key AND n.key < r.e AND r.lsn > n.lsn)""",
    "m6_store_recovered": LIVE,
    "r10_store_raw_scan": f"""WITH {LOG} SELECT op, key, e AS "end", {PUT}, lsn FROM log
  WHERE op < 2 AND key >= '{LOW}' AND key < '{HIGH}' OR op = 2 AND e > '{LOW}' AND key < '{HIGH}'""",
    "w9_store_runs": f"""WITH {LOG}, n AS (SELECT count(*) AS total FROM log),
  parts AS (SELECT i, total * i // {BATCHES} AS low, total * (i + 1) // {BATCHES} AS high FROM n, range({BATCHES}) AS r(i))
  SELECT i + 1 AS id, count(*) FILTER (WHERE op < 2) AS record_count, count(*) FILTER (WHERE op = 1) AS tombstone_count,
    count(*) FILTER (WHERE op = 2) AS range_tombstone_count, min(lsn) AS min_lsn, max(lsn) AS max_lsn,
    min(key) FILTER (WHERE op < 2) AS min_key, max(key) FILTER (WHERE op < 2) AS max_key
  FROM parts JOIN log ON lsn > low AND lsn <= high GROUP BY i""",
}
