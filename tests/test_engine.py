"""The log engine: the resolution matrix, boundaries, compaction keeping the visible state, and random logs against a dict."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import keys
from stratalog.operators import compact, flush, log, resolve, scan, sweep


def make(spark, rows, run=lambda lsn: 0):
    return spark.createDataFrame([(op, bytearray(k), e and bytearray(e), v and bytearray(v), lsn, ts, 0, run(lsn)) for op, k, e, v, lsn, ts in rows], log.schema())


def put(k, v, lsn, ts=0):
    return (0, k, None, v, lsn, ts)


def dele(k, lsn, ts=0):
    return (1, k, None, None, lsn, ts)


def rdel(s, e, lsn, ts=0):
    return (2, s, e, None, lsn, ts)


def state(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([put(b"a", b"1", 50, 100), rdel(b"a", b"z", 40, 90)], ("Put", 50)),
        ([put(b"a", b"1", 50, 100), rdel(b"a", b"z", 60, 110)], ("RangeDelete", 60)),
        ([dele(b"a", 50, 100), rdel(b"a", b"z", 60, 110)], ("RangeDelete", 60)),
        ([dele(b"a", 70, 120), rdel(b"a", b"z", 60, 110)], ("Delete", 70)),
        ([put(b"a", b"1", 10), put(b"a", b"2", 20), put(b"a", b"3", 15)], ("Put", 20)),
        ([put(b"b", b"1", 10)], ("NotFound", None)),
        ([put(b"a", b"1", 10), rdel(b"0", b"a", 20)], ("Put", 10)),
    ],
)
def test_matrix(spark, rows, want):
    got = resolve.outcome(spark.createDataFrame([(bytearray(b"a"),)], "key binary"), make(spark, rows)).first()
    assert (got.outcome, got.lsn) == want


def test_interleaved(spark):
    rows = [put(k.encode(), str(i).encode(), i) for i, k in enumerate("abcde", 1)] + [rdel(b"b", b"d", 6), put(b"c", b"revived", 7), rdel(b"c", b"e", 8), put(b"d", b"final", 9)]
    assert state(resolve.visible(make(spark, rows))) == {b"a": b"1", b"d": b"final", b"e": b"5"}


def test_scan_bounds(spark):
    data = make(spark, [put(k, b"v", i) for i, k in enumerate([b"key", b"key1", b"key10", b"key2", b"\x00", b"\x7f", b"\xfe", b"\xff", b"\xff\x01"], 1)])
    names = lambda df: [bytes(r.key) for r in df.collect()]
    assert names(scan.scan(data, bytearray(b"key"), bytearray(b"key1"))) == [b"key"]
    assert names(scan.scan(data, bytearray(b"key1"), bytearray(b"key2"))) == [b"key1", b"key10"]
    assert names(scan.scan(data, bytearray(b"\x00"), bytearray(b"\xff\xff"))) == [b"\x00", b"key", b"key1", b"key10", b"key2", b"\x7f", b"\xfe", b"\xff", b"\xff\x01"]
    assert names(scan.scan(data, bytearray(b"key"), bytearray(b"key"))) == []
    assert names(scan.prefix_scan(data, bytearray(b"key1"))) == [b"key1", b"key10"]
    with pytest.raises(ValueError):
        scan.scan(data, bytearray(b""), bytearray(b"z"))


def test_raw_scan_order(spark):
    rows = [put(f"key{i}".encode(), b"v", i + 1) for i in range(10)]
    rows += [rdel(b"key2", b"key6", 11), put(b"key3", b"v", 12), put(b"key4", b"v", 13), rdel(b"key7", b"key:", 14), put(b"key8", b"v", 15), dele(b"key0", 16), dele(b"key1", 17)]
    got = [(bytes(r.key), r.lsn) for r in scan.raw_scan(make(spark, rows), bytearray(b"key0"), bytearray(b"key9\xff")).collect()]
    want = [("key0", 16), ("key0", 1), ("key1", 17), ("key1", 2), ("key2", 11), ("key2", 3), ("key3", 12), ("key3", 4), ("key4", 13), ("key4", 5), ("key5", 6), ("key6", 7), ("key7", 14), ("key7", 8), ("key8", 15), ("key8", 9), ("key9", 10)]
    assert got == [(k.encode(), n) for k, n in want]


def test_properties(spark):
    rows = [put(b"aaa", b"v", 10, 1000), put(b"bbb", b"v", 20, 2000), dele(b"ccc", 30, 3000), rdel(b"ddd", b"eee", 40, 4000)]
    p = flush.run_properties(make(spark, rows)).first()
    assert (p.record_count, p.tombstone_count, p.range_tombstone_count, p.min_lsn, p.max_lsn, p.min_ts, p.max_ts) == (3, 1, 1, 10, 40, 1000, 4000)
    assert (bytes(p.min_key), bytes(p.max_key), bytes(p.min_range_start), bytes(p.max_range_end)) == (b"aaa", b"ccc", b"ddd", b"eee")


def random_log(seed, ops=600, n=120, with_ranges=0.95):
    rng, rows, live = random.Random(seed), [], {}
    for lsn in range(1, ops + 1):
        draw, i = rng.random(), rng.randrange(n)
        k = f"key_{i:04}".encode()
        if draw < 0.6 or draw >= with_ranges:
            v = f"v{lsn}".encode()
            rows.append(put(k, v, lsn))
            live[k] = v
        elif draw < 0.75:
            rows.append(dele(k, lsn))
            live.pop(k, None)
        else:
            e = f"key_{min(n, i + rng.randint(1, 20)):04}".encode()
            rows.append(rdel(k, e, lsn))
            live = {x: y for x, y in live.items() if not k <= x < e}
    return rows, live


@pytest.mark.parametrize("seed", [1, 42])
def test_random_log_and_compactions(spark, seed):
    rows, live = random_log(seed)
    data = make(spark, rows, run=lambda lsn: lsn // 100).cache()
    assert state(resolve.visible(data)) == live
    own = ["op", "key", "end", "value", "lsn", "ts"]
    merged = compact.minor(data.where("run_id in (1, 2, 4)")).select(own).union(data.where("run_id not in (1, 2, 4)").select(own))
    assert state(resolve.visible(merged)) == live
    collected = compact.tombstone_gc(data.where("run_id = 3"), data).select(own).union(data.where("run_id <> 3").select(own))
    assert state(resolve.visible(collected)) == live
    assert state(compact.major(data)) == live


def test_paint_and_least_of_against_plain_loops():
    rng = np.random.default_rng(0)
    for n, m in ((1, 3), (7, 20), (40, 60)):
        low = rng.integers(0, n, m)
        high = np.minimum(n, low + rng.integers(0, n + 1, m))
        value, run = rng.integers(0, 50, m), rng.integers(0, 4, m)

        def two(pairs):
            best = min(pairs, default=(sweep.NONE, -1))
            return best[0], min((v for v, r in pairs if r != best[1]), default=sweep.NONE)

        v1, r1, v2 = sweep.paint(low, high, value, run, n)
        for i in range(n):
            over = [(v, r) for a, z, v, r in zip(low, high, value, run, strict=True) if a <= i < z]
            assert v1[i] == two(over)[0] and (not over or (v1[i], r1[i]) in over)
            assert v2[i] == min((v for v, r in over if r != r1[i]), default=sweep.NONE)
        places, owner = rng.integers(0, 50, n), rng.integers(0, 4, n)
        v1, r1, v2 = sweep.least_of((places, owner, np.full(n, sweep.NONE)), low, high)
        for i in range(m):
            inside = [(v, r) for v, r in zip(places[low[i] : high[i]], owner[low[i] : high[i]], strict=True)]
            assert v1[i] == two(inside)[0]
            assert v2[i] == min((v for v, r in inside if r != r1[i]), default=sweep.NONE)


def test_many_overlapping_range_deletes(spark):
    """100,000 range deletes, all over one another, and one wide one; a pair for each point and range would be ten thousand millions."""
    n = 100_000
    name = lambda c: F.format_string("k%08d", c)
    tombs = spark.range(n).select(name(F.col("id") * 7 % n).alias("start"), name(F.col("id") * 7 % n + 1 + F.col("id") % 90_000).alias("end"), (F.col("id") + 1).alias("lsn"))
    points = spark.range(0, n, 10).select(name(F.col("id")).alias("key"), F.lit(50_000).cast("long").alias("lsn"))
    got = {r.key: r.covering_lsn for r in resolve.covering(points, tombs).collect()}
    rows = [(i * 7 % n, i * 7 % n + 1 + i % 90_000, i + 1) for i in range(n)]
    want = np.zeros(n, np.int64)
    for a, z, lsn in rows:
        want[a:z] = lsn  # lsn ascends
    assert got == {f"k{i:08d}": int(want[i]) for i in range(0, n, 10) if want[i]}
    left = {r.key for r in resolve.uncovered(points, tombs).collect()}
    assert left == {f"k{i:08d}" for i in range(0, n, 10) if want[i] <= 50_000}
    plan = resolve.uncovered(points, tombs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", [3, 4])
def test_droppable_against_pairs(spark, seed):
    """Wide and narrow range deletes over several runs, each judged against every record."""
    rng, rows = random.Random(seed), []
    for lsn in range(1, 500):
        k, draw = rng.randrange(400), rng.random()
        if draw < 0.5:
            rows.append(put(b"k%03d" % k, b"v", lsn))
        elif draw < 0.7:
            rows.append(dele(b"k%03d" % k, lsn))
        else:
            rows.append(rdel(b"k%03d" % k, b"k%03d" % (k + 1 + rng.choice([1, 5, 40, 500])), lsn))
    of = {r[4]: rng.randrange(5) for r in rows}
    data = make(spark, rows, run=lambda lsn: of[lsn])
    pts = [(k, lsn, of[lsn], op) for op, k, _, _, lsn, _ in rows if op < 2]
    spans = [(k, e, lsn, of[lsn]) for op, k, e, _, lsn, _ in rows if op == 2]
    want = {lsn for k, lsn, run, op in pts if op == 1 and not any(k == x and y < lsn and r != run for x, y, r, _ in pts) and not any(s <= k < e and y < lsn and r != run for s, e, y, r in spans)}
    assert {r.lsn for r in compact.droppable_points(data, data).collect()} == want
    want = {lsn for s, e, lsn, run in spans if not any(s <= k < e and y < lsn and (r != run or op == 0) for k, y, r, op in pts)}
    assert {r.lsn for r in compact.droppable_ranges(data, data).collect()} == want
    assert want


def test_range_outside_the_points_survives_a_merge(spark):
    data = make(spark, [put(b"m", b"old", 1), put(b"a", b"v", 2), rdel(b"l", b"z", 3)], run=lambda lsn: 0 if lsn == 1 else 1)
    kept = compact.minor(data.where("run_id = 1"))
    assert state(resolve.visible(kept.union(data.where("run_id = 0").select(kept.columns)))) == {b"a": b"v"}


def test_age_is_lsn_not_run_id(spark):
    data = make(spark, [put(b"k", b"old", 1), dele(b"k", 2)], run=lambda lsn: 9 if lsn == 1 else 3)  # the older record is in a run with a higher id
    assert compact.droppable_points(data.where("run_id = 3"), data).count() == 0


def test_droppable(spark):
    data = make(spark, [dele(b"never", 5), rdel(b"x", b"y", 6), put(b"x1", b"v", 7)], run=lambda lsn: 1)
    assert compact.droppable_points(data, data).count() == 1
    assert compact.droppable_ranges(data, data).count() == 1


def test_tiers():
    t = compact.Tiering(small=50, least=2, most=3)
    tiers = compact.size_tiers([(1, 10), (2, 20), (3, 100), (4, 110), (5, 120), (6, 130), (7, 1000)], t)
    assert tiers == [[1, 2], [3, 4, 5, 6], [7]]
    assert compact.pick_tier(tiers, t) == [3, 4, 5]
    assert compact.pick_tier([[1]], t) is None


def test_tier_table_agrees(spark):
    rng = random.Random(3)
    runs = [(i, rng.choice([10, 60, 90, 100, 150, 400, 900])) for i in range(30)]
    t = compact.Tiering()
    want = {i: n for n, tier in enumerate(compact.size_tiers(sorted(runs, key=lambda r: (r[1], r[0])), t)) for i in tier}
    assert {r.run_id: r.tier for r in compact.tier_table(spark.createDataFrame(runs, "run_id long, file_size long"), t).collect()} == want


def test_numbering_and_sealing(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    got = {r.x: r.lsn for r in log.numbered(rows, 10, ["x"]).collect()}
    assert got == {i: 11 + i for i in range(100)}
    data = make(spark, [put(b"k%d" % i, b"v" * (i % 5 + 1), i) for i in range(1, 50)])
    batches = sorted((r.start_lsn, r.end_lsn, r.bytes) for r in flush.sealed(data, 100).collect())
    assert batches[0][0] == 1 and batches[-1][1] == 49 and all(b[2] <= 100 for b in batches)
    assert all(a[1] + 1 == b[0] for a, b in zip(batches, batches[1:], strict=False))
    for arrow in (1000, 7):  # whatever the size of a batch of rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow))
        sizes = [flush.RECORD_BYTES + len(b"k%d" % i) + i % 5 + 1 for i in range(1, 50)]
        want, have = [], None
        for i, x in enumerate(sizes, 1):
            have = (have[0], i, have[2] + 1, have[3] + x) if have and have[3] + x <= 100 else (i, i, 1, x)
            want = [*(w for w in want if w[0] != have[0]), have]
        writers = data.withColumn("writer", F.lit("w")).union(data.withColumn("writer", F.lit("x")))
        got = sorted(tuple(r) for r in flush.sealed(writers, 100, by=["writer"]).collect())
        assert got == [(w, n, *x) for w in "wx" for n, x in enumerate(want)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_invalid_rows(spark):
    data = make(spark, [put(b"", b"v", 1), put(b"k", b"v", 2), rdel(b"b", b"a", 3), (0, b"k", None, None, 4, 0)])
    assert {r.lsn: r.problem for r in log.invalid(data).collect()} == {1: "empty key", 3: "start is not below end", 4: "empty value"}


def test_keys(spark):
    assert keys.successor(b"ab\xff\xff") == b"ac" and keys.successor(b"\xff") is None and keys.successor("u1/") == "u10"
    row = spark.range(1).select(keys.shown(F.lit("ab")), keys.file_name(F.lit(7), ".sst"), keys.file_number(F.lit("x/000042.log")), keys.age_seconds(F.lit(1), F.lit(10**10)), keys.checksum(F.lit("ab"))).first()
    assert tuple(row) == ("6162", "000007.sst", 42, 0, 2659403885)
    exact = spark.range(1).select(keys.seconds(F.lit(1_999_999_999_999_999_999)), keys.seconds(F.lit(-1)), keys.seconds(F.lit(0))).first()
    assert tuple(exact) == (1_999_999_999, -1, 0)


def test_empty_log(spark):
    none = log.empty(spark)
    assert resolve.visible(none).count() == 0 and flush.run_properties(none).count() == 0 and flush.memtable_stats(none).first().versions == 0
    assert math.isclose(compact.tier_table(flush.run_properties(none)).count(), 0)


@pytest.mark.parametrize("fine", [2, compact.FINE])
def test_overlaps_are_counted_without_pairs(spark, monkeypatch, fine):
    monkeypatch.setattr(compact, "FINE", fine)
    rng, rows = random.Random(7), []
    key = lambda: b"%02d" % rng.randrange(40)
    for lsn in range(1, 500):
        a, b = sorted((key(), key()))
        rows.append(rdel(a, b, lsn) if lsn % 3 == 0 and a < b else put(a, b"v", lsn))
    data = make(spark, rows, run=lambda lsn: lsn % 50 if lsn > 100 else lsn // 7)
    runs = flush.run_properties(data)
    want = {r.older_run: r.n for r in compact.overlapping_runs(data, runs).groupBy("older_run").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain: dict[int, int] = {}
    of = lambda lsn: lsn % 50 if lsn > 100 else lsn // 7
    for run in {of(r[4]) for r in rows}:
        own = [r for r in rows if of(r[4]) == run]
        held = [r[1] for r in own if r[0] < 2]
        n = sum(r[0] == 2 and of(r[4]) != run and min(held) < r[2] and max(held) >= r[1] and min(x[4] for x in own) < r[4] for r in rows) if held else 0
        plain |= {run: n} if n else {}
    assert {r.older_run: r.n for r in compact.overlap_counts(data, runs).collect()} == want == plain


def test_overlapping_runs_makes_no_pairs(spark, tmp_path):
    """300 runs and 300 range deletes over all of them: the query's steps make far fewer rows than there are pairs."""
    from stratalog.plans import queries

    kinds = [("view", 0), ("view", 99), ("error", 85)]
    rows = [(500 * run + i, 1, kind, 1.0, '{"k": %d}' % k) for run in range(300) for i, (kind, k) in enumerate(kinds)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = queries.overlapping_runs(spark, str(tmp_path))
        execution = df._jdf.queryExecution()
        got = {r[0]: r[1] for r in (list(execution.executedPlan().executeCollectPublic()) and df.collect())}
        todo, most = [execution.executedPlan()], 0
        while todo:
            node = todo.pop()
            found = node.metrics().get("numOutputRows")
            most = max(most, found.get().value() if found.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {run: 299 - run for run in range(299)}
    assert 0 < most < 20_000 < sum(got.values())


def test_buckets_are_searched_in_compiled_steps(spark):
    """No interpreted projection into whose rows the cuts are copied, and the places are those of a plain search."""
    cuts = list(range(0, 3000, 3))
    column = spark.range(1).select(F.lit(cuts).alias("c")).scalar()
    found = sweep.halved(sweep.halved(spark.range(-2, 3005).withColumn("none", F.lit(None).cast("long")), column, "b", "id"), column, "n", "none")
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert [r.b for r in got] == np.searchsorted(cuts, range(-2, 3005), "right").tolist() and {r.n for r in got} == {0}
