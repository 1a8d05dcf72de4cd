"""Newest days and pruning from the file index: no job may run to find them."""

import contextlib
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from daymart.operators import contracts, joins, profiling, topk
from daymart.session import StageArea
from daymart.sources import partitions, tables

DAYS = ["20221230", "20231229", "20231231", "20240105", "20240109"]


@pytest.fixture(scope="module")
def path(spark):
    where = StageArea(spark, "partitions").path("facts")
    spark.createDataFrame([(i, i % 3, DAYS[i % 5]) for i in range(50)], "id long, kind int, inc_day string").write.partitionBy("inc_day").parquet(where)
    return where


@pytest.fixture(scope="module", params=["files", "catalog"])
def facts(request, spark, path):
    if request.param == "files":
        return spark.read.parquet(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS part_facts (id long, kind int, inc_day string) USING parquet PARTITIONED BY (inc_day) LOCATION '{path}'")
    spark.sql("MSCK REPAIR TABLE part_facts")
    spark.sql("ALTER TABLE part_facts ADD IF NOT EXISTS PARTITION (inc_day = '20240301')")  # a day without files
    return spark.table("part_facts")


@contextlib.contextmanager
def jobs(spark, most):
    group = f"group-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "test")
    try:
        yield
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= most
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_newest_day_without_a_job(spark, facts):
    with jobs(spark, 0):
        assert partitions.days(facts) == DAYS[::-1]
        assert partitions.days(facts.where("inc_day < '20240101'")) == DAYS[2::-1]
        assert partitions.days(facts.select("id", "inc_day")) == DAYS[::-1]
        assert partitions.days(facts.where("inc_day > '2025'")) == []
        assert profiling.latest_partition(facts) == "20240109"
        assert profiling.latest_partition(facts, bounded=True, today=date(2025, 6, 1)) == "20240109"
        assert profiling.latest_partition(facts, bounded=True, today=date(2030, 6, 1)) == "20240109"
        assert profiling.latest_partition(facts, bounded=True, today=date(2023, 6, 1)) == "20231231"
        found = joins.latest_available(facts, "20240108")
        touched = contracts.scanned_partitions(found, "inc_day")
        report = topk.latest_partition(facts)
    assert report.collect()[0].latest_partition == "20240109"
    assert touched.collect()[0].partitions == 1
    assert {r.inc_day for r in found.collect()} == {"20240105"} and found.count() == 10
    assert joins.latest_available(facts, "20210101").collect() == []
    assert {r.inc_day for r in joins.latest_available(facts, "20240108", since="20240106").collect()} == set()


def test_newest_day_with_rows(spark, facts):
    with jobs(spark, 2):  # one aggregate: its map stage and its result
        assert {p.partition_filters for p in partitions.scans(joins.latest_available(facts, "20240109", cond="kind = 0"))} != {0}
    old = joins.latest_available(facts, "20240109", cond="id = 1")  # only in the second oldest day
    assert {r.inc_day for r in old.collect()} == {"20231229"}
    assert joins.latest_available(facts, "20240109", cond="id = 99").collect() == []


def test_row_filters_are_not_ignored(facts):
    """Where rows are filtered or made, the file index must not answer."""
    assert partitions.days(facts.where("kind = 5")) is None
    assert partitions.days(facts.limit(3)) is None
    assert partitions.days(facts.groupBy("inc_day").count()) is None
    assert partitions.days(facts.withColumn("inc_day", F.lit("20990101"))) is None
    assert partitions.days(facts.withColumn("day", F.col("inc_day")), "day") is None
    assert topk.latest_partition(facts.where("id = 1")).collect()[0].latest_partition == "20231229"
    assert profiling.latest_partition(facts.where("id = 1")) == "20231229"
    assert joins.latest_available(facts.where("id < 3"), "20240101").count() == 1


def test_frames_without_partitions(spark):
    df = spark.createDataFrame([("20240101",), ("20240103",), (None,), ("n/a",)], "inc_day string")
    assert partitions.days(df) is None
    assert topk.latest_partition(df).collect()[0].latest_partition == "20240103"
    assert contracts.scanned_partitions(df, "inc_day", 1).collect()[0].over_limit
    dates = df.where("inc_day < 'a'").select(F.to_date("inc_day", "yyyyMMdd").alias("inc_day"))
    assert profiling.latest_partition(dates) == date(2024, 1, 3)


def test_scan_report(spark, facts):
    with jobs(spark, 0):
        both = facts.where("inc_day = '20240105'").join(facts.where("inc_day >= '20231231'").select("id", "kind"), "id")
        report = partitions.scan_report(both)
    rows = report.orderBy("scan").collect()
    assert [r.partitions for r in rows][0] == 1 and rows[1].partitions >= 3
    assert all(r.partition_columns == ["inc_day"] and r.files and r.bytes for r in rows)
    assert [r.partition_filters > 0 for r in rows] == [True, True]
    assert contracts.unpruned_scans(facts) == 1 and contracts.unpruned_scans(both) == 0


@pytest.mark.parametrize("kind, values", [("int", [20240101, 20240203]), ("date", [date(2024, 1, 1), date(2024, 2, 3)])])
def test_other_day_types(spark, kind, values):
    name = f"part_{kind}"
    where = StageArea(spark, name).path("facts")
    df = spark.createDataFrame([(1, values[0]), (2, values[1]), (3, None)], f"id int, d {kind}")
    spark.sql(f"CREATE TABLE {name} (id int, d {kind}) USING parquet PARTITIONED BY (d) LOCATION '{where}'")
    tables.write_partitions(df, name, "d")
    assert partitions.days(spark.table(name), "d") == values[::-1]
