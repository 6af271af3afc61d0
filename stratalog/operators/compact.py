"""Rewriting a log into a smaller one with the same visible state.

Age is a matter of lsn, never of run ids: a merged run gets a new id but holds old records. Runs are read whole, without
key bounds, so that range deletes outside the keys of the points aren't lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import age_seconds
from .flush import flush_entries
from .log import DELETE, PUT, RANGE_DELETE, points, ranges
from .resolve import latest, visible
from .sweep import cuts_of, least_inside, stabbed, with_buckets

#: Blocks of 2**FINE lsns and more are counted in buckets of the key space.
FINE = 16


@dataclass(frozen=True)
class Tiering:
    low: float = 0.5
    high: float = 1.5
    small: int = 50
    least: int = 4
    most: int = 32


def size_tiers(runs: list[tuple[int, int]], tiering: Tiering = Tiering()) -> list[list[int]]:
    """Run ids in tiers of like size, from (run id, size). What is too small for tiers is one of its own, the first.

    Tiers are metadata: one entry a run, on the driver.
    """
    ordered = sorted(runs, key=lambda r: r[1])
    tiers = [[i for i, size in ordered if size < tiering.small]]
    tiers = [t for t in tiers if t]
    total = 0
    open_tier: list[int] = []
    for i, size in (r for r in ordered if r[1] >= tiering.small):
        mean = total / len(open_tier) if open_tier else size
        if open_tier and not mean * tiering.low <= size <= mean * tiering.high:
            tiers.append(open_tier)
            open_tier, total = [], 0
        open_tier.append(i)
        total += size
    return [*tiers, open_tier] if open_tier else tiers


def tier_table(runs: DataFrame, tiering: Tiering = Tiering()) -> DataFrame:
    """(run_id, tier): the same as a DataFrame expression, over the (run_id, file_size) rows of the runs table."""
    kind = "array<struct<run_id:bigint,tier:bigint>>"
    start = F.struct(F.lit(-1).cast("long").alias("tier"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("small"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        small = x["file_size"] < F.lit(tiering.small)
        mean = acc["total"] / acc["n"]
        same = (acc["n"] > 0) & F.when(small | acc["small"], small & acc["small"]).otherwise((x["file_size"] >= mean * tiering.low) & (x["file_size"] <= mean * tiering.high))
        tier = F.when(same, acc["tier"]).otherwise(acc["tier"] + 1)
        return F.struct(
            tier.alias("tier"),
            F.when(same, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"),
            F.when(same, acc["total"] + x["file_size"]).otherwise(x["file_size"]).alias("total"),
            small.alias("small"),
            F.concat(acc["out"], F.array(F.struct(x["run_id"].alias("run_id"), tier.alias("tier")))).alias("out"),
        )

    ordered = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("file_size").cast("long").alias("file_size"), F.col("run_id").cast("long").alias("run_id")))).alias("rows"))
    return ordered.select(F.inline(F.aggregate("rows", start, step, lambda acc: acc["out"])))


def pick_tier(tiers: list[list[int]], tiering: Tiering = Tiering()) -> list[int] | None:
    """The tier with most runs, the first of several, if it has enough; its smallest runs, no more than `most`."""
    best = max((t for t in tiers if len(t) >= tiering.least), key=len, default=None)
    return best and best[: tiering.most]


def minor(log: DataFrame) -> DataFrame:
    """Some runs as one: the newest point of each key and every range delete."""
    return flush_entries(log)


def major(log: DataFrame) -> DataFrame:
    """All runs as one: the visible puts and nothing else."""
    live = visible(log)
    return live.select(F.lit(PUT).alias("op"), "key", F.lit(None).cast(log.schema["end"].dataType).alias("end"), "value", "lsn", F.lit(None).cast("long").alias("ts"))


def tombstone_candidate(runs: DataFrame, ratio: float, now: int | None = None, least_age: int = 0) -> DataFrame:
    """run_id and ratio of the run with the greatest share of deletes, if that is `ratio` or more; the lowest run_id of several. runs: creation_ts only with least_age."""
    share = (F.col("tombstone_count") + F.col("range_tombstone_count")).cast("double") / F.greatest(F.col("record_count"), F.lit(1)).cast("double")
    out = runs.withColumn("ratio", share).where(F.col("ratio") >= ratio)
    if least_age:
        out = out.where(age_seconds(F.lit(now), F.col("creation_ts")) >= least_age)
    return out.orderBy(F.col("ratio").desc(), "run_id").select("run_id", "ratio").limit(1)


def _hides(value: str, run: str = "run") -> Column:
    """Whether v1, r1, v2 hold a value below another's that is of another run."""
    other = F.when(F.col("r1") != F.col(run), F.col("v1")).otherwise(F.col("v2"))
    return F.coalesce(other < F.col(value), F.lit(False))


def droppable_points(target: DataFrame, others: DataFrame) -> DataFrame:
    """Point deletes of the runs in target (key, lsn, ...) that hide nothing: no older point of the key and no older range delete over it elsewhere.

    What is elsewhere is read from the two oldest of different runs, of a key's points and of the range deletes over it.
    """
    tombs = points(target).where(F.col("op") == DELETE)
    each = points(others).groupBy(F.col("key").alias("k"), "run_id").agg(F.min("lsn").alias("lsn"))
    two = each.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("lsn", "run_id"))), 1, 2).alias("x"))  # one a run
    two = two.select("k", F.get("x", F.lit(0)).lsn.alias("v1"), F.get("x", F.lit(0)).run_id.alias("r1"), F.get("x", F.lit(1)).lsn.alias("v2"))
    out = tombs.join(two, F.col("key") == F.col("k"), "left").where(~_hides("lsn", "run_id")).select(*tombs.columns)
    spans = ranges(others).select("start", "end", F.col("lsn").alias("value"), F.col("run_id").alias("run"))
    return stabbed(out, spans, others.select("key", "lsn")).where(~_hides("lsn", "run_id")).select(*tombs.columns)


def droppable_ranges(target: DataFrame, others: DataFrame) -> DataFrame:
    """Range deletes of target (start, end, lsn, run_id) that hide nothing: no older point of another run and no older put of their own run in the range."""
    tombs = ranges(target)
    old = points(others).select("key", F.col("lsn").alias("value"), F.when(F.col("op") == PUT, -1).otherwise(F.col("run_id")).cast("long").alias("run"))
    found = least_inside(tombs.select("start", "end", F.col("run_id").alias("run")), old, others.select("key", "lsn"))
    found = found.select(F.col("start").alias("s"), F.col("end").alias("e"), F.col("run").alias("r"), F.when(F.col("r1") != F.col("run"), F.col("v1")).otherwise(F.col("v2")).alias("oldest"))
    found = found.groupBy("s", "e", "r").agg(F.min("oldest").alias("oldest"))
    return tombs.join(found, (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")) & (F.col("run_id") == F.col("r")) & (F.col("oldest") < F.col("lsn")), "left_anti")


def tombstone_gc(target: DataFrame, everything: DataFrame, drop_ranges: bool = True) -> DataFrame:
    """The runs in target without the deletes that hide nothing; everything: the whole log, target included. drop_ranges: range deletes too."""
    best = latest(points(target).select("key", "op", "value", "lsn", "ts", "run_id")).withColumn("end", F.lit(None).cast(target.schema["end"].dataType))
    own = ["op", "key", "end", "value", "lsn", "ts", "run_id"]
    kept = best.select(own).union(target.where(F.col("op") == RANGE_DELETE).select(own))
    gone = droppable_points(kept, everything).select("lsn")
    if drop_ranges:
        gone = gone.union(droppable_ranges(kept, everything).select("lsn"))
    return kept.join(gone, "lsn", "left_anti").select(own[:-1])


def overlapping_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """For each range delete the runs with older records whose keys overlap it: lsn, older_run. runs is metadata, one row a run.

    Runs and range deletes meet in the first bucket of the key space that both touch, so that each pair comes once. There may be as many
    pairs as there are runs times range deletes: where their number is enough, take overlap_counts.
    """
    cuts = cuts_of(log.select("key", "lsn"))
    r = runs.where("min_key is not null").select(F.col("run_id").alias("older_run"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"), "min_lsn")
    r = with_buckets(r, cuts, r_from="lo", r_to="hi").withColumn("bucket", F.explode(F.sequence("r_from", "r_to")))
    t = with_buckets(ranges(log).select("start", "end", "lsn", "run_id"), cuts, t_from="start", t_to="end")
    t = t.withColumn("bucket", F.explode(F.sequence("t_from", "t_to")))
    meet = (F.col("older_run") != F.col("run_id")) & (F.col("lo") < F.col("end")) & (F.col("hi") >= F.col("start")) & (F.col("min_lsn") < F.col("lsn"))
    # a run in each of its buckets is too much to broadcast
    return t.join(r.hint("merge"), "bucket").where((F.col("bucket") == F.greatest("r_from", "t_from")) & meet).select("lsn", "older_run")


def overlap_counts(log: DataFrame, runs: DataFrame) -> DataFrame:
    """older_run and n, the pairs of overlapping_runs that each run is in, without making them. Runs in none are left out, as are range deletes that are empty.

    A range delete misses a run by ending at or below its least key or by starting above its greatest, and never does both. So n is the number
    of starts up to the greatest key less that of ends up to the least, of range deletes above the run's least lsn; its own are taken off.
    One lsn is above another where they agree down to some bit k, which the first has and the other hasn't. So a range delete lies in a block of
    2**k lsns for each of its bits, a run asks one block for each bit that its least lsn lacks, and inside a block the order of keys tells
    the number. Blocks from 2**FINE on are split by buckets of the key space, and the rows of the buckets before are added.
    """
    r = runs.where("min_key is not null").select("run_id", "min_key", "max_key", "min_lsn")
    t = ranges(log).where("start < end").select("start", "end", "lsn", "run_id")
    cuts, top = cuts_of(log.select("key", "lsn")), log.agg(F.max("lsn")).scalar()

    def sides(rows: DataFrame, up: str, down: str, bit: int) -> DataFrame:
        """run_id (of those who ask), side, bucket, key, k, block and n (1 for what is counted)."""
        one = lambda side, key: F.struct(F.lit(side).alias("side"), F.col(key).alias("key"))
        rows = with_buckets(rows.select("run_id", "lsn", F.inline(F.array(one(1, up), one(-1, down)))), cuts, bucket="key").withColumn("_top", top)
        rows = rows.withColumn("k", F.explode(F.expr(f"filter(sequence(0, 62), k -> shiftright(_top, k) > 0 AND shiftright(lsn, k) & 1 = {bit})")))
        bucket = F.when(F.col("k") >= FINE, F.col("bucket")).otherwise(0).alias("bucket")
        return rows.select("run_id", "side", bucket, "key", "k", F.expr(f"shiftright(lsn, k) + {1 - bit}").alias("block"), F.lit(bit).cast("long").alias("n"))

    def counted(rows: DataFrame, parts: list[str], *order: Column) -> DataFrame:
        """What is held before each row that asks."""
        to = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("found", F.sum("n").over(to)).where("n = 0").select("run_id", (F.col("side") * F.col("found")).alias("n"))

    block = ["side", "k", "block"]
    held, asked = sides(t, "start", "end", 1), sides(r.withColumnRenamed("min_lsn", "lsn"), "max_key", "min_key", 0)
    inside = counted(held.union(asked), [*block, "bucket"], F.col("key"), F.col("n").desc())
    full = held.where(F.col("k") >= FINE).groupBy(*block, "bucket").agg(F.sum("n").alias("n")).withColumn("run_id", F.lit(None).cast("long"))
    before = counted(full.unionByName(asked.where(F.col("k") >= FINE).select(full.columns)), block, F.col("bucket"), F.col("n"))
    meet = (F.col("min_key") < F.col("end")) & (F.col("max_key") >= F.col("start")) & (F.col("min_lsn") < F.col("lsn"))
    own = t.join(r, "run_id").where(meet).select("run_id", F.lit(-1).cast("long").alias("n"))
    return inside.union(before).union(own).groupBy(F.col("run_id").alias("older_run")).agg(F.sum("n").alias("n")).where("n > 0")


class Strategy(Protocol):
    """What a store asks of a compaction strategy. Runs are dicts with their properties, id and creation_ts; config is a DbConfig."""

    def to_merge(self, runs: list[dict], config) -> list[int] | None:
        """Ids of runs to merge next, None if none should be."""

    def to_collect(self, runs: list[dict], config, now: int) -> dict | None:
        """The run whose deletes should be looked at."""

    def minor(self, log: DataFrame) -> DataFrame: ...

    def collected(self, target: DataFrame, everything: DataFrame, config) -> DataFrame: ...

    def major(self, log: DataFrame) -> DataFrame: ...


class SizeTiered:
    """Merges the fullest tier of runs of like size; collects the run with the greatest share of deletes."""

    def to_merge(self, runs: list[dict], config) -> list[int] | None:
        tiering = Tiering(least=config.min_compaction_threshold, most=config.max_compaction_threshold)
        return pick_tier(size_tiers([(r["id"], r["file_size"]) for r in runs], tiering), tiering)

    def to_collect(self, runs: list[dict], config, now: int) -> dict | None:
        share = lambda r: (r["tombstone_count"] + r["range_tombstone_count"]) / max(1, r["record_count"])
        old = lambda r: max(0, now - r["creation_ts"]) // 10**9 >= config.tombstone_compaction_interval
        return max((r for r in runs if share(r) >= config.tombstone_compaction_ratio and old(r)), key=lambda r: (share(r), -r["id"]), default=None)

    def minor(self, log: DataFrame) -> DataFrame:
        return minor(log)

    def collected(self, target: DataFrame, everything: DataFrame, config) -> DataFrame:
        return tombstone_gc(target, everything, config.tombstone_range_drop)

    def major(self, log: DataFrame) -> DataFrame:
        return major(log)


#: Strategies by the name that a configuration gives; others may be added.
STRATEGIES: dict[str, Strategy] = {"size_tiered": SizeTiered()}
