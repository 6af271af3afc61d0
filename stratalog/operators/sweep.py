"""Spans [start, end) against points over ordered keys, without comparing pairs.

The key space is cut into buckets at sampled keys. A span becomes a piece in the bucket of each of its ends; the buckets strictly between
those are covered whole, and what covers them is said by two overlapping blocks of 2**k buckets a span, so that a wide span costs no
more rows than a narrow one. Inside a bucket everything is done in one sweep over sorted keys: ``paint`` gives each elementary
interval the least value of the spans over it, in O(n log n) steps of numpy, whatever overlaps.

``stabbed`` answers for points: spans are turned into disjoint segments, and each point takes the last segment that begins at or before
it, by a window function inside its bucket; the points themselves never leave the JVM. ``least_inside`` answers for spans: the
least value of the points inside. Both carry the least value and the least of another run than that one's, which is what it
takes to leave a run out of the question. Values are compared downwards: for a greatest lsn, pass its negative.

The cuts come from a scalar subquery, so that building a plan runs nothing; their number is bounded (``MOST_BUCKETS``), as is
whatever is gathered of buckets. Rows that agree in span and run are merged before they are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BUCKETS, OVERSAMPLE, STEP = 4096, 8, 32
NONE = np.iinfo(np.int64).max
#: Rows that a sweep takes at once, beyond which it stops at the end of a bucket.
ROWS = 500_000


def cuts_of(keys: DataFrame, flat: bool = False) -> Column:
    """At most MOST_BUCKETS cuts, ascending and distinct, in lists of STEP (flat: in one), sampled from keys (key and what tells its rows apart)."""
    n = min(MOST_BUCKETS, 4 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = keys.orderBy(F.xxhash64(*keys.columns)).limit(OVERSAMPLE * n).agg(F.sort_array(F.collect_list(keys.columns[0])).alias("k"))
    cuts = sample.select(F.array_distinct(F.filter("k", lambda x, i: i % OVERSAMPLE == OVERSAMPLE - 1)).alias("c"))
    if flat:
        return cuts.scalar()
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size("c") - 1) / STEP).cast("int")), lambda i: F.slice("c", i * STEP + 1, STEP))
    return cuts.select(parts.alias("parts")).scalar()


def with_buckets(rows: DataFrame, cuts: Column, **keys: str) -> DataFrame:
    """rows with, under each name in keys, how many of the cuts are at or below the column it names."""

    def search(k: Column) -> Column:
        part = F.greatest(F.lit(0), F.size(F.filter("_cuts", lambda p: F.get(p, F.lit(0)) <= k)) - 1)
        return part * STEP + F.size(F.filter(F.get("_cuts", part), lambda x: x <= k))

    # a key is often an expression: evaluated once
    found = {name: F.element_at(F.transform(F.array(key), search), 1) for name, key in keys.items()}
    return rows.withColumn("_cuts", cuts).withColumns(found).drop("_cuts")


def halved(rows: DataFrame, cuts: Column, name: str, key: str) -> DataFrame:
    """with_buckets for flat cuts, by halving in plain expressions, one a step.

    A stage compiles them and the cuts stay a reference, where a higher-order function has its cuts copied into each row. Compiling takes
    seconds, and a filter on name must not be pushed below, as each step names the one before twice.
    """
    out = rows.withColumn("_cuts", cuts).withColumn(name, F.lit(0))
    for i in range(MOST_BUCKETS.bit_length() - 1, -1, -1):
        half = 1 << i
        out = out.withColumn(name, F.col(name) + F.when(F.get("_cuts", F.col(name) + (half - 1)) <= F.col(key), half).otherwise(0))
    return out.drop("_cuts")


# two least values of different runs, as arrays (v1, r1, v2)

Two = tuple[np.ndarray, np.ndarray, np.ndarray]


def nothing(n: int) -> Two:
    return np.full(n, NONE), np.full(n, -1, np.int64), np.full(n, NONE)


def merged(a: Two, b: Two) -> Two:
    swap = b[0] < a[0]
    first = [np.where(swap, y, x) for x, y in zip(a, b, strict=True)]
    rest = [np.where(swap, x, y) for x, y in zip(a, b, strict=True)]
    return first[0], first[1], np.minimum(first[2], np.where(rest[1] != first[1], rest[0], rest[2]))


def grouped(at: np.ndarray, value: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, Two]:
    """The two least of each place in at."""
    order = np.lexsort((value, at))
    at, value, run = at[order], value[order], run[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    own = np.repeat(run[first], np.diff(np.concatenate((first, [len(at)]))))
    return at[first], (value[first], run[first], np.minimum.reduceat(np.where(run != own, value, NONE), first))


def _level(size: np.ndarray) -> np.ndarray:
    """floor(log2(size)) of positive numbers."""
    return np.frexp(size.astype(float))[1] - 1


def paint(low: np.ndarray, high: np.ndarray, value: np.ndarray, run: np.ndarray, n: int) -> Two:
    """For each place below n the two least of the ranges [low, high) over it."""
    some = high > low
    low, high, value, run = low[some], high[some], value[some], run[some]
    out = nothing(n)
    if not len(low):
        return out
    level = _level(high - low)
    for k in range(int(level.max()), -1, -1):
        if k < level.max():  # a block of 2 ** (k + 1) places is two of 2 ** k
            step = min(1 << k, n)
            out = merged(out, tuple(np.concatenate((x, y[: n - step])) for x, y in zip(nothing(step), out, strict=True)))
        own = level == k
        if own.any():
            at, found = grouped(np.concatenate((low[own], high[own] - (1 << k))), np.tile(value[own], 2), np.tile(run[own], 2))
            for x, y in zip(out, merged(tuple(x[at] for x in out), found), strict=True):
                x[at] = y
    return out


def least_of(places: Two, low: np.ndarray, high: np.ndarray) -> Two:
    """For each range [low, high) the two least of the places in it."""
    out, some = nothing(len(low)), np.flatnonzero(high > low)
    if not len(some):
        return out
    level = _level(high[some] - low[some])
    for k in range(int(level.max()) + 1):
        own = some[level == k]
        if len(own):
            found = merged(tuple(x[low[own]] for x in places), tuple(x[high[own] - (1 << k)] for x in places))
            for x, y in zip(out, found, strict=True):
                x[own] = y
        step = 1 << k
        places = merged(places, tuple(np.concatenate((y[step:], x)) for x, y in zip(nothing(min(step, len(places[0]))), places, strict=True)))
    return out


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches in pieces that end where a bucket does."""
    have, size = [], 0
    for b in batches:
        if size >= ROWS and b.num_rows:
            last = have[-1].column("bucket")[-1].as_py()
            split = int(np.searchsorted(b.column("bucket").to_numpy(), last, "right"))
            if split < b.num_rows:
                yield pa.Table.from_batches([*have, b.slice(0, split)])
                have, size, b = [], 0, b.slice(split)
        if b.num_rows:
            have.append(b)
            size += b.num_rows
    if have:
        yield pa.Table.from_batches(have)


def _bucket_ends(bucket: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each row the place at which the next bucket begins; places are below n."""
    fresh = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    return np.concatenate((place[np.flatnonzero(fresh)[1:]], [n]))[np.cumsum(fresh) - 1]


def _ends(index: np.ndarray, rows: pa.Table, bucket_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that begin a piece, and where it begins and ends. kind 0 begins piece id, kind 1 ends it; one without an end goes to the end of its bucket."""
    kind, ids = rows.column("kind").to_numpy(), rows.column("id").to_numpy()
    begin, end = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    high = bucket_end[begin].copy()
    if len(end):
        end = end[np.argsort(ids[end], kind="stable")]
        at = np.minimum(np.searchsorted(ids[end], ids[begin]), len(end) - 1)
        hit = ids[end][at] == ids[begin]
        high[hit] = index[end[at[hit]]]
    return begin, index[begin], high


def _placed(spans: DataFrame, cuts: Column) -> DataFrame:
    """spans (start, end, value, run) without repeats, with the buckets a and z of their ends."""
    once = spans.groupBy("start", "end", "run").agg(F.min("value").alias("value"))
    return with_buckets(once, cuts, a="start", z="end").withColumn("id", F.monotonically_increasing_id())


def _blocks(placed: DataFrame) -> DataFrame:
    """(k, at) of the two blocks of 2**k buckets that make up the buckets strictly between a and z."""
    # id keeps the condition above what finds a and z, so that the shuffle below is the same for blocks and pieces
    inner = placed.where("z - a > 1 AND id >= 0").withColumn("k", F.floor(F.log2(F.col("z") - F.col("a") - 1)).cast("int"))
    both = F.array_distinct(F.array(F.col("a") + 1, F.col("z") - F.expr("shiftleft(1, k)")))
    return inner.withColumn("at", F.explode(both))


def _pieces(placed: DataFrame, key: T.DataType, more: list[str] = ()) -> DataFrame:
    """bucket, key, kind (0 begins, 1 ends), id, value, run and more of the span: the events of the pieces in the buckets of the ends."""
    null = F.lit(None).cast(key)

    def e(bucket: Column, at: Column, kind: int, twin: int) -> Column:
        return F.struct(bucket.alias("bucket"), at.alias("key"), F.lit(kind).alias("kind"), (F.col("id") * 2 + twin).alias("id"), "value", "run", *more)

    one = F.array(e(F.col("a"), F.col("start"), 0, 0), e(F.col("a"), F.col("end"), 1, 0))
    two = F.array(e(F.col("a"), F.col("start"), 0, 0), e(F.col("z"), null, 0, 1), e(F.col("z"), F.col("end"), 1, 1))
    return placed.select(F.inline(F.when(F.col("a") == F.col("z"), one).otherwise(two)))


def _between(placed: DataFrame) -> DataFrame:
    """bucket, value, run: the two least over each bucket that spans cover whole."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*([b.column(c).to_numpy() for c in ("k", "at", "value", "run")] for b in batches), strict=True)]
        if cols and len(cols[0]):
            k, at, value, run = cols
            high = at + (1 << k.astype(np.int64))
            v1, r1, v2 = paint(at.astype(np.int64), high, value, run, int(high.max()))
            for v, r in ((v1, r1), (v2, np.full(len(v2), -2, np.int64))):
                own = np.flatnonzero(v != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(v[own]), pa.array(r[own])], ["bucket", "value", "run"])

    blocks = _blocks(placed).groupBy("k", "at", "run").agg(F.min("value").alias("value"))
    two = F.slice(F.array_sort(F.collect_list(F.struct("value", "run"))), 1, 2)  # one a run; runs are metadata
    few = blocks.groupBy("k", "at").agg(two.alias("x")).select("k", "at", F.inline("x"))
    # two rows a block, MOST_BUCKETS * log(MOST_BUCKETS) blocks at most
    return few.select("k", "at", "value", "run").repartition(1).mapInArrow(down, "bucket int, value long, run long")


def segments(spans: DataFrame, cuts: Column) -> DataFrame:
    """bucket, key, v1, r1, v2: from key on (null: from the bucket's beginning) the least value of the spans over it, its run, and the least of another run."""
    kind = spans.schema["start"].dataType
    placed = _placed(spans, cuts)
    whole = _between(placed).select("bucket", F.lit(None).cast(kind).alias("key"), F.lit(0).alias("kind"), (-1 - F.monotonically_increasing_id()).alias("id"), "value", "run")
    events = _pieces(placed, kind).union(whole)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            bucket, key = rows.column("bucket").to_numpy(), rows.column("key").combine_chunks()
            plain = pc.fill_null(key, b"" if pa.types.is_binary(key.type) else "")
            fresh = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            new = fresh.copy()
            new[1:] |= pc.not_equal(plain[1:], plain[:-1]).to_numpy(zero_copy_only=False)
            place = np.cumsum(new) - 1
            n = int(place[-1]) + 1
            begin, low, high = _ends(place, rows, _bucket_ends(bucket, place, n))
            found = paint(low, high, rows.column("value").to_numpy()[begin], rows.column("run").to_numpy()[begin], n)
            first = np.flatnonzero(new)
            keep = fresh[first]
            for x in found:
                keep[1:] |= x[1:] != x[:-1]
            own = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first[own]], pa.int32()), key.take(pa.array(first[own])), *(pa.array(x[own]) for x in found)], ["bucket", "key", "v1", "r1", "v2"])

    dealt = events.repartition("bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first())
    return dealt.mapInArrow(sweep, T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("v1", "r1", "v2"))]))


def stabbed(points: DataFrame, spans: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """points (key, ...) with v1, r1, v2 of the spans (start, end, value, run) over their key; null where there are none. keys: where cuts come from."""
    cuts = cuts_of(keys if keys is not None else points.select("key").union(spans.select("start")))
    of = lambda row, seg: (row.alias("_row"), seg.alias("_seg"))
    row, seg = F.struct(*points.columns), F.struct("v1", "r1", "v2")
    found = segments(spans, cuts).select("bucket", "key", *of(F.lit(None).cast(points.schema), seg))
    rows = with_buckets(points.select("key", *of(row, F.lit(None).cast("struct<v1:bigint,r1:bigint,v2:bigint>"))), cuts, bucket="key").select("bucket", "key", "_row", "_seg")
    order = Window.partitionBy("bucket").orderBy(F.col("key").asc_nulls_first(), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = found.union(rows).withColumn("_seg", F.last("_seg", ignorenulls=True).over(order)).where(F.col("_row").isNotNull())
    some = lambda c: F.when(F.col(f"_seg.{c}") != int(NONE), F.col(f"_seg.{c}")).alias(c)
    return out.select("_row.*", some("v1"), F.when(F.col("_seg.v1") != int(NONE), F.col("_seg.r1")).alias("r1"), some("v2"))


def least_inside(spans: DataFrame, points: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """start, end, run, v1, r1, v2: the two least of the points (key, value, run) in parts of each of spans (start, end, run); several rows a span, none without points."""
    cuts = cuts_of(keys if keys is not None else points.select("key").union(spans.select("start")))
    kind = spans.schema["start"].dataType
    placed = _placed(spans.select("start", "end", "run", F.lit(0).cast("long").alias("value")), cuts)
    once = with_buckets(points.groupBy("key", "run").agg(F.min("value").alias("value")), cuts, bucket="key")
    # whole buckets: the two least of each block of 2**k buckets, MOST_BUCKETS * log(MOST_BUCKETS) rows at most
    each = once.groupBy("bucket", "run").agg(F.min("value").alias("value")).groupBy("bucket").agg(F.slice(F.array_sort(F.collect_list(F.struct("value", "run"))), 1, 2).alias("x"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("bucket").to_numpy(), b.column("value").to_numpy(), b.column("run").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        bucket, value, run = (np.concatenate(x) for x in zip(*got, strict=True))
        n = int(bucket.max()) + 1
        at, found = grouped(bucket.astype(np.int64), value, run)
        places = nothing(n)
        for x, y in zip(places, found, strict=True):
            x[at] = y
        k = 0
        while 1 << k <= MOST_BUCKETS:
            own = np.flatnonzero(places[0] != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(own, pa.int32()), *(pa.array(x[own]) for x in places)], ["k", "at", "v1", "r1", "v2"])
            step = min(1 << k, n)
            front = tuple(np.concatenate((y[step:], x)) for x, y in zip(nothing(step), places, strict=True))
            # blocks that begin before the first bucket don't exist, those that reach beyond the last hold what there is
            places = merged(places, front)
            k += 1

    blocks = each.select("bucket", F.inline("x")).repartition(1).mapInArrow(up, "k int, at int, v1 long, r1 long, v2 long")
    whole = _blocks(placed).join(blocks, ["k", "at"]).select("start", "end", "run", "v1", "r1", "v2")
    null = F.lit(None).cast(kind)
    begins = _pieces(placed, kind, ["start", "end"])
    events = begins.union(once.select("bucket", "key", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("id"), "value", "run", null.alias("start"), null.alias("end")))
    schema = T.StructType([T.StructField("start", kind), T.StructField("end", kind), *(T.StructField(c, T.LongType()) for c in ("run", "v1", "r1", "v2"))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(batches):
            is_point = rows.column("kind").to_numpy() == 2
            before = np.cumsum(is_point) - is_point  # points before each row
            ends = _bucket_ends(rows.column("bucket").to_numpy(), before, int(is_point.sum()))
            begin, low, high = _ends(before, rows, ends)
            value, run = rows.column("value").to_numpy(), rows.column("run").to_numpy()
            found = least_of((value[is_point], run[is_point], np.full(int(is_point.sum()), NONE)), low, high)
            own = np.flatnonzero(found[0] != NONE)
            at = pa.array(begin[own])
            spans_ = [rows.column(c).combine_chunks().take(at) for c in ("start", "end", "run")]
            yield pa.RecordBatch.from_arrays([*spans_, *(pa.array(x[own]) for x in found)], schema.fieldNames())

    dealt = events.repartition("bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "kind")
    return whole.union(dealt.mapInArrow(sweep, schema))
