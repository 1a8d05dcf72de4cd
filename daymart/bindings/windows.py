"""Window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.days import week_start
from ..operators import bitmaps as B
from ..operators import windows as W
from . import bind
from .frames import ITEMS, MOVES, ORDERS, SESSIONS, items, moves, orders, sessions, table

DAY_NO = "datediff('day', DATE '1970-01-01', CAST(strptime(inc_day, '%Y%m%d') AS DATE))"


@bind(
    "w1_period_change",
    "inc_day:s cnt:i prev_cnt:i pct_change:r2",
    f"""SELECT inc_day, cnt, lag(cnt) OVER (ORDER BY inc_day) AS prev_cnt,
      (cnt - lag(cnt) OVER (ORDER BY inc_day)) * 100.0 / lag(cnt) OVER (ORDER BY inc_day) AS pct_change
      FROM (SELECT inc_day, count(*) AS cnt FROM {ORDERS} GROUP BY 1)""",
)
def w1(spark, sf):
    daily = orders(spark, sf).groupBy("inc_day").agg(F.count(F.lit(1)).alias("cnt"))
    return W.period_change(daily, "inc_day", "cnt", scale=6)


@bind(
    "w2_rolling_mean",
    "warehouse_id:i sku_id:s inc_day:s outbound:d rolling_mean:r6",
    f"""WITH d AS (SELECT warehouse_id, sku_id, inc_day, sum(abs(quantity)) AS outbound FROM {MOVES}
        WHERE lower(movement_type) = 'outbound' GROUP BY ALL)
      SELECT warehouse_id, sku_id, inc_day, outbound, CAST(sum(outbound) OVER (PARTITION BY warehouse_id, sku_id
        ORDER BY {DAY_NO} RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / 7 AS rolling_mean FROM d""",
)
def w2(spark, sf):
    out = moves(spark, sf).where("lower(movement_type) = 'outbound'").withColumn("outbound", F.abs("quantity"))
    return W.rolling_mean(out, ["warehouse_id", "sku_id"], "inc_day", "outbound")


@bind(
    "w3_rolling_distinct",
    "inc_day:s entities:i",
    f"""WITH a AS (SELECT DISTINCT {DAY_NO} AS d, inc_day, customer_id FROM {ORDERS})
      SELECT x.inc_day, count(DISTINCT y.customer_id) AS entities FROM (SELECT DISTINCT d, inc_day FROM a) x
      JOIN a y ON y.d BETWEEN x.d - 29 AND x.d GROUP BY x.inc_day""",
)
def w3(spark, sf):
    return W.rolling_distinct(orders(spark, sf), "inc_day", "customer_id", 30)


@bind(
    "w3_bitmap_distinct",
    "inc_day:s entities:i",
    f"""WITH a AS (SELECT DISTINCT {DAY_NO} AS d, inc_day, customer_id FROM {ORDERS})
      SELECT x.inc_day, count(DISTINCT y.customer_id) AS entities FROM (SELECT DISTINCT d, inc_day FROM a) x
      JOIN a y ON y.d BETWEEN x.d - 6 AND x.d GROUP BY x.inc_day""",
)
def w3b(spark, sf):
    """Weekly distinct customers of every day, from day bitmaps."""
    o = orders(spark, sf)
    numbers = B.number_entities(o, "customer_id", buckets=4)
    return B.distinct_rolling(B.day_bitmaps(o, "inc_day", "customer_id", numbers), "inc_day", 7)


@bind(
    "w4_dedup_latest",
    "order_id:i line_no:i product_id:i item_amount:d",
    f"""SELECT order_id, line_no, product_id, item_amount FROM {ITEMS} QUALIFY row_number() OVER
      (PARTITION BY order_id, line_no ORDER BY inc_day DESC, product_id, item_amount) = 1""",
)
def w4(spark, sf):
    order = [F.desc("inc_day"), F.asc("product_id"), F.asc("item_amount")]
    return W.dedup_latest(items(spark, sf), ["order_id", "line_no"], order)


@bind(
    "w5_first_period",
    "customer_id:i first_week:s",
    f"SELECT customer_id, CAST(CAST(date_trunc('week', min(order_time)) AS DATE) AS VARCHAR) AS first_week FROM {ORDERS} GROUP BY 1",
)
def w5(spark, sf):
    return W.first_period(orders(spark, sf), "customer_id", week_start("order_time"), "first_week")


@bind(
    "w6_retained",
    "user_id:i week_no:i retained:b",
    f"""WITH p AS (SELECT DISTINCT user_id, CAST(floor(({DAY_NO} + 3) / 7) AS BIGINT) AS week_no FROM {SESSIONS})
      SELECT a.user_id, a.week_no, b.user_id IS NOT NULL AS retained FROM p a
      LEFT JOIN p b ON a.user_id = b.user_id AND a.week_no = b.week_no + 1""",
)
def w6(spark, sf):
    weeks = sessions(spark, sf).withColumn("week_no", F.floor((F.unix_date(F.col("login_time").cast("date")) + 3) / 7))
    return W.retained(weeks, "user_id", "week_no")


@bind(
    "w7_rank_top",
    "supplier_id:i order_id:i item_amount:d rank:i",
    f"""SELECT supplier_id, order_id, item_amount, row_number() OVER (PARTITION BY supplier_id
      ORDER BY item_amount DESC, order_id, line_no, product_id) AS rank FROM {ITEMS} QUALIFY rank <= 10""",
)
def w7(spark, sf):
    order = [F.desc("item_amount"), F.asc("order_id"), F.asc("line_no"), F.asc("product_id")]
    return W.rank_top(items(spark, sf), ["supplier_id"], order, 10)


@bind(
    "w8_budget_window",
    "customer_id:i order_id:i running:d",
    f"""SELECT customer_id, order_id, sum(pay_amount) OVER (PARTITION BY customer_id ORDER BY order_id DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {ORDERS} QUALIFY running <= 1000000""",
)
def w8(spark, sf):
    return W.budget_window(orders(spark, sf), ["customer_id"], "order_id", "pay_amount", 1_000_000, block=1000)
