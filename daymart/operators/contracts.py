"""Data contracts: schemas, deliveries, dry runs, re-runs and partition pruning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import StageArea
from ..sources import partitions
from .sets import diff_datasets


def check_contract(
    df: DataFrame, target: T.StructType, partition_cols: Sequence[str] = (), dynamic: bool = False
) -> DataFrame:
    """Differences between an output and its target: number, order, names and types.

    A static partition column is not selected; a dynamic one comes last.
    """
    parts = set(partition_cols)
    want = [f for f in target.fields if f.name not in parts]
    if dynamic:
        want += [f for f in target.fields if f.name in parts]
    got = df.schema.fields
    rows = []
    if len(got) != len(want):
        rows.append((0, "count", str(len(want)), str(len(got))))
    for i, (w, g) in enumerate(zip(want, got), 1):
        if w.name.lower() != g.name.lower():
            rows.append((i, "name", w.name, g.name))
        elif w.dataType != g.dataType:
            rows.append((i, "type", w.dataType.simpleString(), g.dataType.simpleString()))
    return df.sparkSession.createDataFrame(rows, "position int, issue string, expected string, actual string")


def missing_fields(spec: DataFrame, target: T.StructType, field: str = "field") -> DataFrame:
    """Specified fields that the target lacks; extra target columns are fine."""
    known = [F.lit(n.lower()) for n in target.fieldNames()]
    name = F.lower(F.trim(field))
    return spec.select(name.alias("field")).where(~F.array_contains(F.array(*known), name)).distinct()


def missing_outputs(expected: DataFrame, delivered: DataFrame, name: str = "table_name") -> DataFrame:
    """Expected tables without a delivery, with severity by layer; stage tables are ignored."""
    table = F.element_at(F.split(F.col(name), r"\."), -1)
    layer = F.element_at(F.split(F.col(name), r"\."), 1)
    mid = table.rlike("^(dws_|dwd_|dim_)")
    return (
        expected.select(name)
        .distinct()
        .where(~layer.startswith("tmp_"))
        .join(delivered.select(name).distinct(), name, "left_anti")
        .withColumn("severity", F.when(mid, "warning").otherwise("critical"))
    )


OUTCOMES = ("ok", "table-missing", "analysis-error", "runtime-error")


def dry_run(
    spark: SparkSession, statements: Mapping[str, str], sources: Mapping[str, DataFrame] | None = None, n: int = 10
) -> DataFrame:
    """Analyse each statement and run it with a limit; the outcome comes from Spark's own
    error condition."""
    rows = []
    for key, sql in statements.items():
        outcome, condition = "ok", None
        try:
            df = spark.sql(sql, **(sources or {}))
        except PySparkException as e:
            condition = e.getCondition()
            missing = (condition or "").startswith("TABLE_OR_VIEW_NOT_FOUND")
            outcome = "table-missing" if missing else "analysis-error"
        else:
            try:
                df.limit(n).collect()
            except PySparkException as e:
                outcome, condition = "runtime-error", e.getCondition()
        rows.append((key, outcome, condition))
    return spark.createDataFrame(rows, "statement string, outcome string, condition string")


def idempotent(fn: Callable[[], DataFrame], keys: Sequence[str]) -> DataFrame:
    """Run a job twice and count the keys per state; only ``same`` is expected.

    Each run is written on its own, so the second can't be a reused part of the first.
    """
    first = fn()
    area = StageArea(first.sparkSession, "idempotent")
    first, second = area.save(first), area.save(fn())
    cols = [c for c in first.columns if c not in keys]
    return diff_datasets(first, second, keys, cols).groupBy("state").agg(F.count(F.lit(1)).alias("keys"))


def scan_filters(df: DataFrame) -> list[int]:
    """Number of partition filters of every scan of a partitioned table in the plan."""
    return [s.partition_filters for s in partitions.scans(df) if s.partition_columns]


def unpruned_scans(df: DataFrame) -> int:
    """Scans that read every partition."""
    return sum(1 for f in scan_filters(df) if not f)


def scanned_partitions(df: DataFrame, day: str, limit: int = 400) -> DataFrame:
    """Number of day partitions that a frame's scans select, against the scan guard.

    Read from the plan; no job runs. A frame without a scan partitioned by the day has its days counted instead.
    """
    found = [s for s in partitions.scans(df) if day in s.partition_columns]
    if found:
        counts = df.sparkSession.createDataFrame([(sum(s.selected[0] for s in found),)], "partitions bigint")
    else:
        counts = df.agg(F.count_distinct(day).alias("partitions"))
    return counts.withColumn("over_limit", F.col("partitions") > limit)
