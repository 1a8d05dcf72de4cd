"""Aggregate expressions and shapes. Everything keeps Spark's partial aggregation, so a
hot group is reduced before it is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import as_col, safe_div


def count_rows() -> Column:
    return F.count(F.lit(1))


def count_when(cond: Column | str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def sum_when(cond: Column | str, value: Column | str) -> Column:
    c = F.expr(cond) if isinstance(cond, str) else cond
    return F.sum(F.when(c, as_col(value)))


def distinct_when(cond: Column | str, value: Column | str) -> Column:
    c = F.expr(cond) if isinstance(cond, str) else cond
    return F.count_distinct(F.when(c, as_col(value)))


def ratio(num: Column, den: Column, scale: int | None = None, percent: bool = False) -> Column:
    """Ratio of two aggregates, NULL on a zero denominator."""
    n = num.cast("double") * 100.0 if percent else num
    return safe_div(n, den, scale)


def sum0(col: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(col)), F.lit(0))


def single_or_null(col: Column | str) -> Column:
    """The value when the group holds exactly one distinct value, else NULL.

    min = max says the same as a distinct count of one, without the extra shuffle.
    """
    lo, hi = F.min(as_col(col)), F.max(as_col(col))
    return F.when(lo == hi, hi)


def daily_avg(col: Column | str, day: Column | str, scale: int = 2) -> Column:
    return safe_div(F.sum(as_col(col)), F.count_distinct(as_col(day)), scale)


def list_agg_distinct(
    df: DataFrame, keys: Sequence[str], col: str, out: str, sep: str = ","
) -> DataFrame:
    """Sorted distinct values of each group as one string.

    Values are made distinct on (keys, value) first, so copies of a hot group are spread
    and dropped before the group comes together.
    """
    values = df.select(*keys, F.col(col).cast("string").alias("_v")).where("_v IS NOT NULL").distinct()
    listed = values.groupBy(*keys).agg(F.concat_ws(sep, F.array_sort(F.collect_list("_v"))).alias(out))
    return listed


def having(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], cond: str) -> DataFrame:
    """Aggregate, then filter on the aggregates."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]).where(cond)


def with_totals(df: DataFrame, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Detail plus subtotal rows in one pass, told apart by ``level`` (0 = detail).

    Filter on ``level`` before summing again, or totals count twice.
    """
    out = df.rollup(*dims).agg(
        F.grouping_id().cast("bigint").alias("_gid"), *[a.alias(n) for n, a in aggs.items()]
    )
    # a rollup sets the low bits first: 0, 1, 3, 7 ... for 0, 1, 2, 3 rolled-up dimensions
    return out.withColumn("level", F.bit_count("_gid").cast("bigint")).drop("_gid")
