"""From writes to runs: budgets, sealed batches, what a flush writes, and what is known about a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import byte_size
from .log import DELETE, RANGE_DELETE, points
from .resolve import latest

#: Bytes charged for a record beside its key and value.
RECORD_BYTES = 24


def record_size(fixed: int = RECORD_BYTES):
    return byte_size(F.col("key"), F.col("end"), F.col("value").cast("string"), fixed=fixed)


def sealed(log: DataFrame, budget: int, size=None, by: list[str] | None = None) -> DataFrame:
    """batch, start_lsn, end_lsn, n and bytes of the batches that a write buffer of `budget` bytes freezes into.

    A record that doesn't fit seals the buffer and goes into the next. That is a fold in lsn order: it runs inside one writer
    (`by`: the writers' columns), streams that writer's (lsn, size) pairs, and holds one batch of them. Writers fold side by side.
    """
    by = by or []
    rows = log.select(*by, F.col("lsn").cast("long").alias("lsn"), (record_size() if size is None else size).cast("long").alias("size"))
    schema = T.StructType([*(rows.schema[c] for c in by), *(T.StructField(c, T.LongType()) for c in ("batch", "start_lsn", "end_lsn", "n", "bytes"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, have = None, 0, None  # have: start, end, records and bytes of the open batch

        def out(sealed_: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*sealed_, strict=True))
            kinds = [b.schema.field(c).type for c in by] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], schema.fieldNames())

        for b in batches:
            lsn, sizes = b.column("lsn").to_numpy(), b.column("size").to_numpy()
            total = np.concatenate(([0], np.cumsum(sizes)))
            names = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
            done, i = [], 0
            while i < b.num_rows:
                if names[i] != writer:
                    if have:
                        done.append((*writer, number, *have))
                    writer, number, have = names[i], 0, None
                stop = int(np.searchsorted(total, total[i] + budget - (have[3] if have else 0), "right")) - 1
                stop = max(stop, i if have else i + 1)  # an empty buffer takes any record
                while stop > i and names[stop - 1] != writer:
                    stop -= 1
                if stop > i:
                    got = int(total[stop] - total[i])
                    have = (have[0], int(lsn[stop - 1]), have[2] + stop - i, have[3] + got) if have else (int(lsn[i]), int(lsn[stop - 1]), stop - i, got)
                    i = stop
                if i < b.num_rows and names[i] == writer:
                    done.append((*writer, number, *have))
                    number, have = number + 1, None
            if done:
                yield out(done)
        if have:
            yield out([(*writer, number, *have)])

    dealt = rows.repartition(*by) if by else rows.repartition(1)  # one buffer is one sequence
    return dealt.sortWithinPartitions(*by, "lsn").mapInArrow(fold, schema)


def flush_entries(log: DataFrame) -> DataFrame:
    """What a flush or a minor merge keeps: the newest point of each key, deletes too, and every range delete."""
    best = latest(points(log).select("key", "op", "value", "lsn", "ts")).withColumn("end", F.lit(None).cast(log.schema["end"].dataType))
    return best.select("op", "key", "end", "value", "lsn", "ts").union(log.where(F.col("op") == RANGE_DELETE).select("op", "key", "end", "value", "lsn", "ts"))


def run_properties(log: DataFrame) -> DataFrame:
    """One row a run_id. Keys are those of points alone; the bounds of range deletes have columns of their own, so that pruning by key stays sound."""
    point, tomb = F.col("op") < RANGE_DELETE, F.col("op") == RANGE_DELETE
    return log.groupBy("run_id").agg(
        F.count_if(point).alias("record_count"),
        F.count_if(F.col("op") == DELETE).alias("tombstone_count"),
        F.count_if(tomb).alias("range_tombstone_count"),
        F.min("lsn").alias("min_lsn"),
        F.max("lsn").alias("max_lsn"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.min(F.when(point, F.col("key"))).alias("min_key"),
        F.max(F.when(point, F.col("key"))).alias("max_key"),
        F.min(F.when(tomb, F.col("key"))).alias("min_range_start"),
        F.max(F.when(tomb, F.col("end"))).alias("max_range_end"),
        F.sum(record_size()).alias("file_size"),
    )


def memtable_stats(log: DataFrame) -> DataFrame:
    """One row: bytes charged, distinct point keys, point versions, point and range deletes."""
    point = F.col("op") < RANGE_DELETE
    return log.agg(
        F.coalesce(F.sum(record_size()), F.lit(0)).cast("long").alias("size"),
        F.count_distinct(F.when(point, F.col("key"))).alias("distinct_keys"),
        F.count_if(point).alias("versions"),
        F.count_if(F.col("op") == DELETE).alias("tombstones"),
        F.count_if(F.col("op") == RANGE_DELETE).alias("range_tombstones"),
    )


def engine_stats(runs: DataFrame, frozen: int | Column) -> DataFrame:
    """One row: frozen batches, runs, their bytes in all and one by one, newest first."""
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("max_lsn", "file_size")), asc=False), lambda x: x.file_size)
    return runs.agg(F.coalesce(F.lit(frozen), F.lit(0)).cast("long").alias("frozen_count"), F.count(F.lit(1)).alias("run_count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), sizes.alias("sizes"))
