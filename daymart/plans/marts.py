"""Worked warehouse marts over frames with the documented column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.days import day_to_date, iso_week, monday_of, shift_day, week_start
from ..functions.exprs import safe_div
from ..operators.aggs import daily_avg, sum0
from ..operators.joins import join_dim


def commerce_daily(orders: DataFrame, paid: Column | str) -> DataFrame:
    """(inc_day, order_count, customer_count, gmv, avg_order_amount) of paid orders."""
    return (
        orders.where(paid)
        .groupBy("inc_day")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.count_distinct("customer_id").alias("customer_count"),
            F.sum("pay_amount").alias("gmv"),
        )
        .withColumn("avg_order_amount", safe_div("gmv", "order_count"))
    )


def commerce_daily_with_refunds(orders: DataFrame, paid: Column | str, refunds: DataFrame, done: Column | str) -> DataFrame:
    """The daily mart with refund_order_count and refund_amount added.

    Both sides are one row per day before the join; the first columns stay as they were.
    """
    back = (
        refunds.where(done)
        .groupBy("inc_day")
        .agg(F.count_distinct("order_id").alias("refund_order_count"), F.sum("refund_amount").alias("refund_amount"))
    )
    out = commerce_daily(orders, paid).join(back, "inc_day", "full")
    return out.na.fill(0, ["refund_order_count", "refund_amount"])


def weekly_retention(sessions: DataFrame, bizdate: str, days: int = 90, ts: str = "login_time") -> DataFrame:
    """(week_id, wau, new_users, retention_rate, avg_session_duration) of the whole weeks that the last 90 days touch.

    Active users have a session with a duration in the week; new users logged in for the first time ever in it, which
    takes one smallest timestamp per user over all history. Retention is the share of the previous week's users who
    came back; the first week has none.
    """
    start = monday_of(shift_day(bizdate, 1 - days))
    active = sessions.where(F.col("inc_day").between(start, bizdate)).where("duration_seconds > 0")
    per_user = active.groupBy(week_start(ts).alias("week"), "user_id").agg(
        F.sum("duration_seconds").alias("_sec"), F.count(F.lit(1)).alias("_n")
    )
    back = F.datediff("week", F.lag("week").over(Window.partitionBy("user_id").orderBy("week"))) == 7
    weekly = per_user.withColumn("_back", back).groupBy("week").agg(
        F.count(F.lit(1)).alias("wau"),
        F.count_if("_back").alias("_back"),
        F.sum("_sec").alias("_sec"),
        F.sum("_n").alias("_n"),
    )
    first = sessions.where(F.col("inc_day") <= bizdate).groupBy("user_id").agg(week_start(F.min(ts)).alias("week"))
    joined = weekly.join(first.groupBy("week").agg(F.count(F.lit(1)).alias("new_users")), "week", "left")
    # one row per week from here on
    before = Window.orderBy("week")
    prev_users = F.when(F.datediff("week", F.lag("week").over(before)) == 7, F.lag("wau").over(before))
    return joined.select(
        iso_week("week").alias("week_id"),
        "wau",
        F.coalesce("new_users", F.lit(0)).alias("new_users"),
        safe_div(F.col("_back"), prev_users, 6).alias("retention_rate"),
        safe_div("_sec", "_n", 6).alias("avg_session_duration"),
    )


def inventory_turnover(snapshots: DataFrame, moves: DataFrame, skus: DataFrame) -> DataFrame:
    """Stock per (day, warehouse, SKU) with 7-day turnover and flags.

    Snapshots (one row per day, warehouse and SKU) and movements are reduced to daily numbers in one aggregation, and
    the window runs over calendar days. Days without outbound count as 0, so turnover is NULL only where the 7 days hold
    none; days without a snapshot count in the window and have no row.
    """
    keys = ["warehouse_id", "sku_id"]
    stock = snapshots.select(*keys, "inc_day", "stock_quantity", "locked_quantity", F.lit(1).alias("_held"))
    gone = moves.where(F.lower("movement_type") == "outbound").select(*keys, "inc_day", F.abs("quantity").alias("_out"))
    daily = (
        stock.unionByName(gone, allowMissingColumns=True)
        .groupBy(*keys, "inc_day")
        .agg(*[F.sum(c).alias(c) for c in ("stock_quantity", "locked_quantity", "_held")], sum0("_out").alias("daily_outbound"))
    )
    week = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-6, 0)
    rolled = daily.withColumn("_dn", F.unix_date(day_to_date("inc_day"))).withColumn("_week", F.sum("daily_outbound").over(week))
    available = F.col("stock_quantity") - F.col("locked_quantity")
    mean = F.when(F.col("_week") != 0, safe_div("_week", F.lit(7)))
    return (
        rolled.where("_held > 0")
        .join(skus.select("sku_id", "safety_stock", "reorder_point"), "sku_id", "left")
        .select(
            "inc_day",
            *keys,
            "stock_quantity",
            available.alias("available_quantity"),
            "daily_outbound",
            safe_div("stock_quantity", mean, 6).alias("turnover_days"),
            F.when(available < F.col("safety_stock"), 1).otherwise(0).alias("stockout_flag"),
            F.when(available < F.col("reorder_point"), 1).otherwise(0).alias("reorder_flag"),
        )
    )


def shop_daily_ticket(payments: DataFrame, shops: DataFrame, day: str, dim_day: str) -> DataFrame:
    """(shop_id, shop_name, pay_amount, order_cnt, avg_ticket) of one day.

    The facts are reduced to one row per shop before the dimension snapshot is joined.
    """
    n = F.count_distinct("order_id")
    facts = (
        payments.where(F.col("inc_day") == day)
        .groupBy("shop_id")
        .agg(sum0("pay_amount").alias("pay_amount"), n.alias("order_cnt"))
        .withColumn("avg_ticket", safe_div("pay_amount", "order_cnt", 6))
    )
    dim = shops.select("shop_id", "shop_name", F.col("inc_day").alias("_dim_day"))
    return join_dim(facts, dim, ["shop_id"], F.col("_dim_day") == dim_day).drop("_dim_day")


def weekly_dept(details: DataFrame, bizdate: str) -> DataFrame:
    """(dept_code, order_cnt, avg_amount, daily_avg) of the run date's Monday to Sunday."""
    start = monday_of(bizdate)
    return (
        details.where(F.col("inc_day").between(start, shift_day(start, 6)))
        .groupBy("dept_code")
        .agg(
            F.sum("order_cnt").alias("order_cnt"),
            safe_div(F.sum("order_amount"), F.sum("order_cnt"), 4).alias("avg_amount"),
            daily_avg("pickup_cnt", "inc_day").alias("daily_avg"),
        )
    )


def city_daily_count(orders: DataFrame, day: str, cond: Column | str) -> DataFrame:
    """(city, order_cnt) of one day under a literal filter."""
    return (
        orders.where(F.col("inc_day") == day).where(cond).groupBy("city").agg(F.count(F.lit(1)).alias("order_cnt"))
    )
