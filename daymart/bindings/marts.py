"""Worked marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.days import day_of, ts_between_days
from ..functions.exprs import money
from ..plans import marts as M
from . import bind
from .frames import BIZDATE, ITEMS, MOVES, ORDERS, SESSIONS, SKUS, SNAPSHOTS, items, moves, orders, sessions, skus, snapshots, table

PAID = "order_status IN ('20','30','40')"
DAILY = f"""SELECT inc_day, count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS customer_count,
  sum(pay_amount) AS gmv, CAST(sum(pay_amount) AS DOUBLE) / count(DISTINCT order_id) AS avg_order_amount
  FROM {ORDERS} WHERE {PAID} GROUP BY 1"""


@bind("b1_commerce_daily", "inc_day:s order_count:i customer_count:i gmv:d avg_order_amount:d", DAILY)
def b1(spark, sf):
    return M.commerce_daily(orders(spark, sf), PAID)


@bind(
    "b2_commerce_daily_refunds",
    "inc_day:s order_count:i customer_count:i gmv:d avg_order_amount:d refund_order_count:i refund_amount:d",
    f"""SELECT inc_day, order_count, customer_count, gmv, avg_order_amount, coalesce(refund_order_count, 0) AS refund_order_count,
      coalesce(refund_amount, 0) AS refund_amount FROM ({DAILY}) FULL JOIN
      (SELECT inc_day, count(DISTINCT order_id) AS refund_order_count, sum(item_amount) AS refund_amount FROM {ITEMS}
       WHERE return_flag = 'R' GROUP BY 1) USING (inc_day)""",
)
def b2(spark, sf):
    refunds = items(spark, sf).withColumnRenamed("item_amount", "refund_amount")
    return M.commerce_daily_with_refunds(orders(spark, sf), PAID, refunds, "return_flag = 'R'")


def _retention(visits: str, lo: str, hi: str) -> str:
    """Weeks from ``lo``, a Monday, to ``hi`` over (user_id, login_time, duration_seconds, inc_day)."""
    week = "CAST(date_trunc('week', login_time) AS DATE)"
    return f"""WITH v AS (SELECT * FROM {visits} WHERE inc_day <= '{hi}'),
      a AS (SELECT user_id, duration_seconds, {week} AS w FROM v WHERE inc_day >= '{lo}' AND duration_seconds > 0),
      u AS (SELECT DISTINCT user_id, w FROM a),
      debut AS (SELECT w, count(*) AS n FROM (SELECT user_id, min({week}) AS w FROM v GROUP BY 1) GROUP BY 1),
      back AS (SELECT x.w, count(*) AS n FROM u x JOIN u y ON x.user_id = y.user_id AND y.w = x.w - 7 GROUP BY 1),
      k AS (SELECT w, count(DISTINCT user_id) AS wau, CAST(sum(duration_seconds) AS DOUBLE) / count(*) AS avg_s FROM a GROUP BY 1)
      SELECT strftime(k.w, '%G-W%V') AS week_id, k.wau, coalesce(debut.n, 0) AS new_users,
        CAST(coalesce(back.n, 0) AS DOUBLE) / p.wau AS retention_rate, k.avg_s AS avg_session_duration
      FROM k LEFT JOIN k p ON p.w = k.w - 7 LEFT JOIN debut ON debut.w = k.w LEFT JOIN back ON back.w = k.w"""


@bind(
    "b3_weekly_retention",
    "week_id:s wau:i new_users:i retention_rate:r6 avg_session_duration:r6",
    _retention(SESSIONS, "20231030", "20240130"),
)
def b3(spark, sf):
    return M.weekly_retention(sessions(spark, sf), "20240130")


@bind(
    "b3_weekly_retention_orders",
    "week_id:s wau:i new_users:i retention_rate:r6 avg_session_duration:r6",
    _retention(
        f"(SELECT customer_id AS user_id, order_time AS login_time, pay_amount AS duration_seconds, inc_day FROM {ORDERS})", "19980316", BIZDATE
    ),
)
def b3o(spark, sf):
    visits = orders(spark, sf).select(
        F.col("customer_id").alias("user_id"), F.col("order_time").alias("login_time"),
        F.col("pay_amount").alias("duration_seconds"), "inc_day",
    )
    return M.weekly_retention(visits, BIZDATE)


@bind(
    "b4_inventory_turnover",
    "inc_day:s warehouse_id:i sku_id:s stock_quantity:d available_quantity:d daily_outbound:d turnover_days:r6 stockout_flag:i reorder_flag:i",
    f"""WITH o AS (SELECT warehouse_id, sku_id, CAST(strptime(inc_day, '%Y%m%d') AS DATE) AS d, sum(abs(quantity)) AS q
        FROM {MOVES} WHERE lower(movement_type) = 'outbound' GROUP BY ALL),
      s AS (SELECT *, CAST(strptime(inc_day, '%Y%m%d') AS DATE) AS d FROM {SNAPSHOTS}),
      last7 AS (SELECT s.warehouse_id, s.sku_id, s.d, CAST(sum(o.q) AS DOUBLE) / 7 AS mean7, sum(o.q) FILTER (o.d = s.d) AS today
        FROM s JOIN o ON o.warehouse_id = s.warehouse_id AND o.sku_id = s.sku_id AND o.d BETWEEN s.d - 6 AND s.d GROUP BY ALL)
      SELECT inc_day, warehouse_id, sku_id, stock_quantity, stock_quantity - locked_quantity AS available_quantity,
        coalesce(today, 0) AS daily_outbound, CAST(stock_quantity AS DOUBLE) / nullif(mean7, 0) AS turnover_days,
        CASE WHEN stock_quantity - locked_quantity < safety_stock THEN 1 ELSE 0 END AS stockout_flag,
        CASE WHEN stock_quantity - locked_quantity < reorder_point THEN 1 ELSE 0 END AS reorder_flag
      FROM s LEFT JOIN last7 USING (warehouse_id, sku_id, d) LEFT JOIN {SKUS} USING (sku_id)""",
)
def b4(spark, sf):
    return M.inventory_turnover(snapshots(spark, sf), moves(spark, sf), skus(spark, sf))


@bind(
    "b5_shop_daily_ticket",
    "shop_id:i shop_name:s pay_amount:d order_cnt:i avg_ticket:r6",
    f"""SELECT f.shop_id, s_name AS shop_name, pay_amount, order_cnt, CAST(pay_amount AS DOUBLE) / order_cnt AS avg_ticket FROM
      (SELECT supplier_id AS shop_id, coalesce(sum(item_amount), 0) AS pay_amount, count(DISTINCT order_id) AS order_cnt
       FROM {ITEMS} WHERE inc_day = '{BIZDATE}' GROUP BY 1) f LEFT JOIN supplier ON shop_id = s_suppkey""",
)
def b5(spark, sf):
    # day filter on the raw timestamp reaches the scan
    day = table(spark, sf, "lineitem").where(ts_between_days("l_shipdate", BIZDATE, BIZDATE))
    payments = day.select(
        F.col("l_suppkey").alias("shop_id"), F.col("l_orderkey").alias("order_id"),
        money("l_extendedprice").alias("pay_amount"), day_of("l_shipdate").alias("inc_day"),
    )
    shops = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("shop_id"), F.col("s_name").alias("shop_name"), F.lit(BIZDATE).alias("inc_day")
    )
    return M.shop_daily_ticket(payments, shops, BIZDATE, BIZDATE)


@bind(
    "b6_weekly_dept",
    "dept_code:s order_cnt:i avg_amount:r4 daily_avg:r2",
    f"""SELECT dept_code, sum(n) AS order_cnt, round(CAST(sum(a) AS DOUBLE) / sum(n), 4) AS avg_amount,
      round(CAST(sum(q) AS DOUBLE) / count(DISTINCT inc_day), 2) AS daily_avg FROM
      (SELECT CAST(supplier_id AS VARCHAR) AS dept_code, inc_day, count(*) AS n, sum(item_amount) AS a, sum(quantity) AS q
       FROM {ITEMS} WHERE inc_day BETWEEN '19980615' AND '19980621' GROUP BY ALL) GROUP BY 1""",
)
def b6(spark, sf):
    detail = (
        items(spark, sf, ("19980615", "19980621"))
        .groupBy(F.col("supplier_id").cast("string").alias("dept_code"), "inc_day")
        .agg(F.count(F.lit(1)).alias("order_cnt"), F.sum("item_amount").alias("order_amount"), F.sum("quantity").alias("pickup_cnt"))
    )
    return M.weekly_dept(detail, BIZDATE)


@bind(
    "b7_city_daily_count",
    "city:s order_cnt:i",
    """SELECT n_name AS city, count(*) AS order_cnt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      WHERE strftime(o_orderdate, '%Y%m%d') = '19980615' AND o_orderpriority <> '5-LOW' GROUP BY 1""",
)
def b7(spark, sf):
    o, c, n = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    day = o.where(ts_between_days("o_orderdate", BIZDATE, BIZDATE))
    joined = day.join(c, day.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = joined.select(day_of("o_orderdate").alias("inc_day"), F.col("n_name").alias("city"), "o_orderpriority")
    return M.city_daily_count(rows, BIZDATE, "o_orderpriority <> '5-LOW'")
