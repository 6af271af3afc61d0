"""The store: lifecycle, configuration, persistence, snapshots and streaming."""

import random

import pytest

from stratalog.plans.db import Closed, Corrupt, Db, DbConfig, InvalidArgument, InvalidConfig
from stratalog.streaming.ingest import ingest


def test_put_get_scan_and_reopen(spark, tmp_path):
    with Db.open(spark, str(tmp_path)) as db:
        for i in range(6):
            db.put(b"k%d" % i, b"v%d" % i)
        db.delete(b"k1")
        db.delete_range(b"k3", b"k5")
        assert db.get(b"k0") == b"v0" and db.get(b"k1") is None and db.get(b"k4") is None
        assert db.scan(b"k0", b"k9") == [(b"k0", b"v0"), (b"k2", b"v2"), (b"k5", b"v5")]
        assert db.scan(b"k5", b"k5") == []
    with pytest.raises(Closed):
        db.get(b"k0")
    db.close()
    with Db.open(spark, str(tmp_path)) as db:  # from write-ahead files
        assert db.get(b"k2") == b"v2"
        assert db.flush() and not db.flush()
        db.put(b"k1", b"again")
        assert [k for k, _ in db.scan(b"k", b"l")] == [b"k0", b"k1", b"k2", b"k5"]
    with Db.open(spark, str(tmp_path)) as db:  # from a run and a write-ahead file
        assert db.get(b"k1") == b"again" and db.stats()["run_count"] == 1


def test_arguments(spark, tmp_path):
    db = Db.open(spark, str(tmp_path))
    for call in (lambda: db.put(b"", b"v"), lambda: db.put(b"k", b""), lambda: db.delete(b""), lambda: db.delete_range(b"b", b"a"), lambda: db.delete_range(b"", b"a"), lambda: db.get(b""), lambda: db.scan(b"", b"a"), lambda: db.put(b"k", b"x" * 70_000)):
        with pytest.raises(InvalidArgument):
            call()


@pytest.mark.parametrize("bad", [{"write_buffer_size": 1023}, {"min_compaction_threshold": 1}, {"max_compaction_threshold": 3}, {"tombstone_compaction_ratio": 0.0}, {"tombstone_compaction_ratio": float("nan")}, {"tombstone_compaction_interval": 604_801}, {"thread_pool_size": 33}, {"compaction_strategy": "leveled"}])
def test_config(bad):
    with pytest.raises(InvalidConfig):
        DbConfig(**bad).validate()
    DbConfig().validate()


def test_compaction_keeps_the_state_and_snapshots(spark, tmp_path):
    rng, live = random.Random(5), {}
    db = Db.open(spark, str(tmp_path), DbConfig(min_compaction_threshold=2))
    for round_ in range(4):
        for i in range(12):
            k = b"k%02d" % rng.randrange(20)
            if rng.random() < 0.7:
                db.put(k, b"v%d" % i)
                live[k] = b"v%d" % i
            elif rng.random() < 0.5:
                db.delete(k)
                live.pop(k, None)
            else:
                e = k + b"5"
                db.delete_range(k, e)
                live = {x: y for x, y in live.items() if not k <= x < e}
        db.flush()
        if round_ == 2:
            pinned, then = db._version.number, dict(live)
    want = sorted(live.items())
    assert db.scan(b"k", b"l") == want
    assert db.minor_compact() and db.scan(b"k", b"l") == want
    db.tombstone_compact()
    assert db.scan(b"k", b"l") == want
    db.major_compact()
    assert db.scan(b"k", b"l") == want and not db.major_compact()
    from stratalog.operators.resolve import visible

    assert {bytes(r.key): bytes(r.value) for r in visible(db.snapshot(pinned)).collect()} == then
    assert db.vacuum(1) and db.scan(b"k", b"l") == want


def test_corrupt_manifest_fails_loudly(spark, tmp_path):
    db = Db.open(spark, str(tmp_path))
    db.put(b"k", b"v")
    db.flush()
    at = next((tmp_path / "manifest").glob("*.json"))
    at.write_text(at.read_text().replace("last_lsn", "lost_lsn"))
    (at.parent / f".{at.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupt):
        Db.open(spark, str(tmp_path))
    assert list((tmp_path / "runs").iterdir())


def test_streamed_batches_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(0, bytearray(b"a"), None, bytearray(b"1"), 1), (0, bytearray(b"b"), None, bytearray(b"2"), 2)], "op int, key binary, end binary, value binary, n long").write.parquet(str(source))
    db = Db.open(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema("op int, key binary, end binary, value binary, n long").parquet(str(source))
    ingest(stream, db, ["n"], str(tmp_path / "check")).awaitTermination()
    assert db.scan(b"a", b"z") == [(b"a", b"1"), (b"b", b"2")]
    again = spark.read.parquet(str(source))
    assert not db.write(again, ["n"], ("ingest", 0)) and db.stats()["run_count"] == 1
    assert db.write(again, ["n"], "by hand")
    for i in range(1, 4):
        assert db.write(again.limit(1), ["n"], ("other", i))
    db = Db.open(spark, str(tmp_path / "db"))  # names and streams are kept
    assert not db.write(again, ["n"], "by hand") and not db.write(again, ["n"], ("other", 2)) and not db.write(again, ["n"], ("ingest", 0))


def names(path, folder):
    return sorted(p.name for p in (path / folder).iterdir() if not p.name.startswith("."))


def spoil(at, text):
    at.write_text(text)
    (at.parent / f".{at.name}.crc").unlink(missing_ok=True)


def test_a_torn_write_ahead_file_is_set_aside(spark, tmp_path):
    db = Db.open(spark, str(tmp_path))
    for i in range(5):
        db.put(b"t%d" % i, b"%d" % i)
    files = sorted((tmp_path / "wal").glob("*.json"))
    spoil(files[3], files[3].read_text()[:-9])
    db = Db.open(spark, str(tmp_path))
    assert [k for k, _ in db.scan(b"t", b"u")] == [b"t0", b"t1", b"t2"] and len(db.skipped) == 2
    assert len(names(tmp_path, "wal-torn")) == 2
    db.put(b"t9", b"after")  # the number of the torn record is free again
    db.put(b"t8", b"after")
    db = Db.open(spark, str(tmp_path))
    assert [k for k, _ in db.scan(b"t", b"u")] == [b"t0", b"t1", b"t2", b"t8", b"t9"] and not db.skipped


def test_a_list_of_changes_is_one_file(spark, tmp_path):
    db = Db.open(spark, str(tmp_path))
    db.apply([("put", b"g1", b"a"), ("put", b"g2", b"b"), ("delete_range", b"g2", b"g3"), ("put", b"g4", b"c"), ("delete", b"g4")])
    assert len(list((tmp_path / "wal").glob("*.json"))) == 1 and db.scan(b"g", b"h") == [(b"g1", b"a")]
    with pytest.raises(InvalidArgument):
        db.apply([("put", b"g9", b"x"), ("delete_range", b"b", b"a")])
    assert db.get(b"g9") is None
    at = next((tmp_path / "wal").glob("*.json"))
    spoil(at, at.read_text()[: at.read_text().index("\n", 200) + 20])
    db = Db.open(spark, str(tmp_path))  # the whole records before the tear
    assert db.get(b"g1") == b"a" and db.skipped
    db.put(b"g7", b"z")
    db = Db.open(spark, str(tmp_path))
    assert db.get(b"g1") == b"a" and db.get(b"g7") == b"z"


def test_a_bad_manifest_falls_back_without_loss(spark, tmp_path):
    db = Db.open(spark, str(tmp_path))
    db.put(b"m1", b"1")
    db.flush()
    batch = spark.createDataFrame([(0, bytearray(b"m5"), None, bytearray(b"5"), 1)], "op int, key binary, end binary, value binary, n long")
    db.write(batch, ["n"])
    db.put(b"m2", b"2")
    db.delete(b"m1")
    db.flush()
    want = db.scan(b"m", b"n")
    for back in (1, 2):
        for at in sorted((tmp_path / "manifest").glob("*.json"))[-back:]:
            spoil(at, at.read_text()[:40])
        again = Db.open(spark, str(tmp_path))
        assert again.scan(b"m", b"n") == want == [(b"m2", b"2"), (b"m5", b"5")] and len(again.skipped) == back
    again.put(b"m3", b"3")
    again.flush()
    again = Db.open(spark, str(tmp_path))
    assert not again.skipped and again.scan(b"m", b"n") == [*want[:1], (b"m3", b"3"), *want[1:]]
    again.vacuum(2)
    assert again.scan(b"m", b"n") == [*want[:1], (b"m3", b"3"), *want[1:]]


def test_sealed_buffers_are_read_and_flushed_in_the_background(spark, tmp_path):
    db = Db.open(spark, str(tmp_path), DbConfig(write_buffer_size=1024))
    with db._flushing:  # as if a flush took long
        for i in range(60):
            db.put(b"f%02d" % i, b"x" * 30)
        s = db.stats()
        assert s["frozen_count"] >= 2 and s["run_count"] == 0
        assert db.get(b"f00") == b"x" * 30 and len(db.scan(b"f", b"g")) == 60
    db.wait()
    s = db.stats()
    assert s["frozen_count"] == 0 and s["run_count"] >= 1 and len(db.scan(b"f", b"g")) == 60
    db.close()
    with Db.open(spark, str(tmp_path)) as again:
        assert len(again.scan(b"f", b"g")) == 60


def test_buffers_answer_without_reading_runs(spark, tmp_path, monkeypatch):
    from stratalog.plans import db as module

    db = Db.open(spark, str(tmp_path))
    db.put(b"p1", b"old")
    db.put(b"p2", b"old")
    db.flush()
    db.put(b"p1", b"new")
    db.delete_range(b"p2", b"p3")
    read = []
    monkeypatch.setattr(module, "read_run", lambda spark_, url, i, own=module.read_run: read.append(i) or own(spark_, url, i))
    assert db.get(b"p1") == b"new" and db.get(b"p2") is None and not read
    assert db.get(b"p0") is None and not read  # outside the keys of the run
    db.flush()
    assert db.get(b"p1") == b"new" and read


def test_a_strategy_of_ones_own(spark, tmp_path, monkeypatch):
    from stratalog.operators import compact

    class Pairs(compact.SizeTiered):
        def to_merge(self, runs, config):
            return [r["id"] for r in runs[-2:]] if len(runs) > 2 else None

    monkeypatch.setitem(compact.STRATEGIES, "pairs", Pairs())
    db = Db.open(spark, str(tmp_path), DbConfig(compaction_strategy="pairs"))
    for i in range(3):
        db.put(b"s%d" % i, b"v")
        db.flush()
    assert db.minor_compact() and not db.minor_compact() and db.stats()["run_count"] == 2 and len(db.scan(b"s", b"t")) == 3


def test_a_bad_batch_leaves_nothing_and_a_batch_is_numbered_once(spark, tmp_path, monkeypatch):
    db, kinds = Db.open(spark, str(tmp_path)), "op int, key binary, end binary, value binary, n long"
    with pytest.raises(InvalidArgument):
        db.write(spark.createDataFrame([(0, bytearray(b"a"), None, bytearray(b"1"), 1), (2, bytearray(b"z"), bytearray(b"b"), None, 2)], kinds), ["n"])
    assert db.stats()["run_count"] == 0 and not names(tmp_path, "runs") and db.scan(b"a", b"z") == []
    from stratalog.operators import log

    checked = []
    monkeypatch.setattr(log, "invalid", lambda rows, own=log.invalid: checked.append(rows.inputFiles()) or own(rows))
    assert db.write(spark.createDataFrame([(0, bytearray(b"a"), None, bytearray(b"1"), 1)], kinds), ["n"]) and db.scan(b"a", b"z") == [(b"a", b"1")]
    assert all("/runs/" in f for files in checked for f in files) and all(checked)  # the written run is looked at, not the batch
