"""Each query of the engine against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratalog.plans import queries

from .oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    agree(spark, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["key", "value", "lsn"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_pairs_of_everything(spark, name):
    """No query joins without an equality, and none runs a job while its plan is built."""
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", name)
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("building") for s in seen.getJobInfo(j).stageIds]
    jobs = [s.name for s in stages if s and not s.name.startswith("parquet at")]  # schemas of the tables
    spark.sparkContext.setJobGroup("", "")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert not jobs


def test_key_bounds_reach_the_events(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = queries.point_get(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(user_id,42)") == plan.count("FileScan")


def test_run_scan_pushes_key_bounds(spark, tmp_path):
    from stratalog.operators import scan
    from stratalog.sources.runs import read_run, write_run
    from tests.test_engine import make, put

    assert write_run(make(spark, [put(b"k%d" % i, b"v", i) for i in range(1, 50)]), str(tmp_path / "r"))["record_count"] == 49
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    bounded = scan.within(read_run(spark, str(tmp_path / "r"), 1), bytearray(b"k1"), bytearray(b"k2")).where("op < 2")
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_runs_have_bloom_filters(spark, tmp_path):
    """Filters on the key are written, and a key that a run lacks reads no row group."""
    from stratalog.sources.runs import read_run, write_run
    from tests.test_engine import make, put

    at = str(tmp_path / "r")
    write_run(make(spark, [put(b"k%05d" % (2 * i), b"v%d" % i, i) for i in range(1, 5000)]), at)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = 0
    for f in (tmp_path / "r").glob("*.parquet"):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf))
        for block in reader.getFooter().getBlocks():
            column = next(c for c in block.getColumns() if c.getPath().toDotString() == "key")
            found += column.getBloomFilterOffset() > 0
        reader.close()
    assert found
    absent = read_run(spark, at, 1).where(F.col("key") == F.lit(bytearray(b"k00101")))
    assert absent.count() == 0
    rows = absent.select("value")
    rows.collect()
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.apply(0).metrics().apply("numOutputRows").value() == 0
