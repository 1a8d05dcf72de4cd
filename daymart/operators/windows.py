"""Window operators. Rows are reduced to one per key and period before any window sorts
them, and top-n filters keep Spark's partial group limit, so no hot key sits in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.days import day_to_date
from ..functions.exprs import as_col, safe_div


def period_change(
    df: DataFrame, day: str, value: str, keys: Sequence[str] = (), scale: int = 2
) -> DataFrame:
    """Previous value and percent change per day; input holds one row per (keys, day)."""
    w = Window.partitionBy(*keys).orderBy(day)
    prev = F.lag(value).over(w)
    change = safe_div((F.col(value) - prev).cast("double") * 100.0, prev, scale)
    return df.withColumns({f"prev_{value}": prev, "pct_change": change})


def rolling_mean(
    df: DataFrame, keys: Sequence[str], day: str, value: str, n: int = 7, out: str = "rolling_mean"
) -> DataFrame:
    """Mean of the daily totals of the n calendar days up to each day.

    Days without rows count as 0; NULL when the n days hold no amount.
    """
    daily = df.groupBy(*keys, day).agg(F.sum(value).alias(value))
    w = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-(n - 1), 0)
    return (
        daily.withColumn("_dn", F.unix_date(day_to_date(day)))
        .withColumn("_total", F.sum(value).over(w))
        .withColumn(out, F.when(F.col("_total") != 0, safe_div("_total", F.lit(n))))
        .drop("_dn", "_total")
    )


def rolling_distinct(
    df: DataFrame, day: str, entity: str, n: int = 30, keys: Sequence[str] = (), out: str = "entities"
) -> DataFrame:
    """Distinct entities seen in the n days up to each active day.

    Each (entity, day) counts from its day until n days later or the entity's next day,
    whichever is first. Those +1/-1 steps are summed per day and accumulated, so the work
    is one row per active entity-day instead of n.
    """
    active = df.select(*keys, entity, F.unix_date(day_to_date(day)).alias("_d")).distinct()
    nxt = F.lead("_d").over(Window.partitionBy(*keys, entity).orderBy("_d"))
    stop = F.least(F.col("_d") + n, nxt)  # least skips a NULL next day
    steps = active.withColumn("_stop", stop).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_d").alias("d"), F.lit(1).alias("s"), F.lit(1).alias("live")),
                F.struct(F.col("_stop").alias("d"), F.lit(-1).alias("s"), F.lit(0).alias("live")),
            )
        ).alias("e"),
    )
    per_day = steps.groupBy(*keys, F.col("e.d").alias("_d")).agg(
        F.sum("e.s").alias("_s"), F.max("e.live").alias("_live")
    )
    # one row per (keys, day) from here on
    w = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_day.withColumn(out, F.sum("_s").over(w).cast("bigint"))
        .where("_live = 1")
        .select(*keys, F.date_format(F.date_from_unix_date("_d"), "yyyyMMdd").alias(day), out)
    )


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order; the order must end in a tie-breaker.

    The rank filter is planned with a partial group limit: each task forwards at most one
    row per key.
    """
    return rank_top(df, keys, order, 1).drop("rank")


def rank_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top n rows per key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_period(df: DataFrame, entity: str, period: Column | str, out: str = "first_period") -> DataFrame:
    return df.groupBy(entity).agg(F.min(as_col(period)).alias(out))


def retained(df: DataFrame, entity: str, period: str, step: int = 1) -> DataFrame:
    """Distinct (entity, period) with ``retained`` = present exactly one step before."""
    pairs = df.select(entity, period).distinct()
    prev = F.lag(period).over(Window.partitionBy(entity).orderBy(period))
    return pairs.withColumn("retained", F.coalesce((F.col(period) - prev == step), F.lit(False)))


def suffix_sum(
    df: DataFrame, keys: Sequence[str], order: str, cost: str, out: str, block: int = 10_000
) -> DataFrame:
    """Running sum of ``cost`` from the highest ``order`` down, per key.

    Works in two levels: blocks of the integer ``order`` are summed first, block totals
    are accumulated per key, and rows are accumulated inside their block. A key with a
    third of all rows is spread over its blocks.
    """
    b = F.floor(F.col(order) / block).cast("bigint")
    rows = df.withColumn("_b", b)
    totals = rows.groupBy(*keys, "_b").agg(F.sum(cost).alias("_t"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_o"))
    inner = (
        Window.partitionBy(*keys, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(offsets, [*keys, "_b"])
        .withColumn(out, F.sum(cost).over(inner) + F.col("_o"))
        .drop("_b", "_o")
    )


def budget_window(
    df: DataFrame, keys: Sequence[str], order: str, cost: str, budget: int, block: int = 10_000
) -> DataFrame:
    """Rows that fit a budget when taken from the newest to the oldest."""
    return suffix_sum(df, keys, order, cost, "running", block).where(F.col("running") <= budget)
