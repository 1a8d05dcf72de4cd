"""Small ordered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import partitions


def latest_partition(df: DataFrame, day: str = "inc_day") -> DataFrame:
    """The newest day that holds data; from the file index where the frame is partitioned by it, else by an aggregate."""
    found = partitions.days(df, day)
    if found is None:
        return df.agg(partitions.newest_day(df, day).alias("latest_partition"))
    return df.sparkSession.createDataFrame([(found[0] if found else None,)], T.StructType([T.StructField("latest_partition", df.schema[day].dataType)]))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Most frequent values, ties broken by value; planned as TakeOrderedAndProject."""
    return (
        df.groupBy(F.col(col).alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc_nulls_last("value"))
        .limit(n)
    )


def failures_first(results: DataFrame, status: str = "status") -> DataFrame:
    return results.orderBy(F.col(status) == "PASSED", "category", "name")
