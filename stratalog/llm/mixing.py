"""Operator 7: mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 5, 2, 1 in turn and share ``SHARE`` of all words; no target passes ``MOST`` times
its source's words, and the excess is shared again by weight. That is water-filling: with sources sorted by cap over weight,
those whose cap lies below the level of the rest take their cap, and the others the level times their weight.

Each document of a source is expected ``target / source size`` times. Documents are ranked within their source by size, longest
first, and then doc_id; the expected copies are summed along that order, one offset is added, and a document is emitted once
for each integer that the sum passes. Sorting by size makes what rounding gains at one document almost cancel at the next, so
that a source's taken words miss the target by less than its longest document. The offset is the best of ``OFFSETS`` drawn
from the source's name and the seed: the one whose taken words come nearest to the target, which matters in small sources.

Ranks come from a range partitioning on (source, size, doc_id): rows are numbered inside their range and shifted by the rows
that the source has in ranges before it, so a source with a third of all rows is spread over many tasks. Only (doc_id, source,
size) is shuffled. What is gathered in one task is one row a source for the targets.

Defined cases: a null text has size 0; null is a source of its own; null doc_ids come last in the ranking; documents of size 0
are taken zero words; equal rows are separate documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, through_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, SEED, OFFSETS = (5, 2, 1), 1.5, 2, "1", 32


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """In [0, 1), the same for every run."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit("#" + seed))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") * F.lit(share) - F.col("capped_before")) / F.col("weight_from"))
    s = s.withColumn("above", F.col("cap") > F.col("level") * F.col("weight"))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("above"), F.struct(F.col("cap") / F.col("weight"), "place"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("above"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, key, source, size) with place: 1, 2, ... within the source, longest first."""
    order = [F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("key")]
    parted = through_table(rows.repartitionByRange(partitions(rows.sparkSession), F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = parted.groupBy("source", "part").count()
    before = before.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inner = parted.withColumn("place", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order)))
    return inner.join(before, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "key", "source", "size", (F.col("place") + F.col("shift")).alias("place"))


def copies_at(u: Column) -> Column:
    """Integers that rate * place + u passes at a row of rate and place."""
    at = lambda place: F.floor(F.col("rate") * place + u)
    return F.least(at(F.col("place")) - at(F.col("place") - 1), F.lit(MOST)).cast("long")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, key, source, size, source_size, target, copies, taken for docs (doc_id, text, source); key: a hash of the text."""
    rows = through_table(docs.select("doc_id", F.xxhash64("text").alias("key"), "source", word_count("text").alias("size")), "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("rate", rate).withColumn("us", F.array(*(offset(F.col("s"), f"{seed}#{k}") for k in range(OFFSETS))))
    same = F.col("source").eqNullSafe(F.col("s"))
    placed = through_table(ranked(rows), "mix-places")
    tried = placed.join(aims, same).groupBy("s", "source_size", "target", "rate", "us").agg(F.array(*(F.sum(copies_at(F.col("us")[k]) * F.col("size")) for k in range(OFFSETS))).alias("sums"))
    misses = F.transform("sums", lambda x, k: F.struct(F.abs(x - F.col("target")).alias("miss"), k.alias("k")))
    chosen = tried.select("s", "source_size", "target", "rate", F.get("us", F.array_min(misses).k).alias("u"))
    out = placed.join(chosen, same).drop("s").withColumn("copies", copies_at(F.col("u")))
    return out.select("doc_id", "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies_of(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Each row of docs as often as the mix takes it, with copy: 1, 2.

    Rows that agree in doc_id, text and source share out the copies that the mix takes of such rows, in the order of a hash of all their
    columns: as many get two, one and none as the mix says.
    """
    order, src = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_ord"), F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_src")
    names = ["_ord", "_key", "_src"]
    taken = mixed(docs, seed).select(order, F.col("key").alias("_key"), src, "copies").where("copies > 0")
    # _n[k - 1]: rows of which k copies or more are taken; one row for all rows that agree
    taken = taken.groupBy(*names).agg(F.array(*(F.count_if(F.col("copies") >= k) for k in range(1, MOST + 1))).alias("_n"))
    rows = docs.select(order, F.xxhash64("text").alias("_key"), src, F.struct(*docs.columns).alias("_row"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("_row")))
    both = rows.join(taken, names).withColumn("_place", place)
    both = both.withColumn("_copies", F.size(F.filter("_n", lambda x: x >= F.col("_place"))).cast("long")).where("_copies > 0")
    number = next(name for name in ("copy", "copy_number", "_copy_number") if name not in docs.columns)
    return both.select("_row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias(number))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str) -> str:
    """CTEs that end in mixed(doc_id, source, size, source_size, target, copies, taken)."""
    return rf"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM by_source),
weighed AS (SELECT *, [5, 2, 1][CAST((place - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 2 AS cap, sum(source_size) OVER () AS total FROM placed),
levels AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own_level FROM weighed),
marked AS (SELECT *, cap > own_level * weight AS above FROM levels),
aims AS (SELECT source, source_size, CASE WHEN above THEN weight * (SELECT own_level FROM marked WHERE above ORDER BY cap::DOUBLE / weight, place LIMIT 1) ELSE CAST(cap AS DOUBLE) END AS target FROM marked),
rated AS (SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id ASC NULLS LAST) AS place
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
draws AS (SELECT source, target, k, CAST('0x' || substr(md5(coalesce(source, '') || '#1#' || k), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM aims, range({OFFSETS}) AS t(k)),
tried AS (SELECT r.source, d.k, d.u, sum(least(floor(rate * place + u) - floor(rate * (place - 1) + u), 2)::BIGINT * size) AS have, any_value(d.target) AS target
  FROM rated r JOIN draws d ON r.source IS NOT DISTINCT FROM d.source GROUP BY r.source, d.k, d.u),
best AS (SELECT source, u FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(have::BIGINT - target), k) = 1),
copied AS (SELECT r.*, CAST(least(floor(rate * place + u) - floor(rate * (place - 1) + u), 2) AS BIGINT) AS copies FROM rated r JOIN best b ON r.source IS NOT DISTINCT FROM b.source),
mixed AS (SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copied)
"""


SQL = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"
