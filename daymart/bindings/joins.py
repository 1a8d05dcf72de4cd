"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.days import day_of
from ..functions.exprs import money
from ..operators import joins as J
from . import bind
from .frames import BIZDATE, ITEMS, ORDERS, SESSIONS, items, orders, sessions, table


@bind(
    "j1_left_relationship",
    "c_custkey:i c_mktsegment:s o_orderkey:i",
    "SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
def j1(spark, sf):
    spec = J.JoinSpec(("c_custkey",), ("o_custkey",), "left", "1:N")
    return J.join_rel(table(spark, sf, "customer"), table(spark, sf, "orders"), spec)


@bind(
    "j2_inner_relationship",
    "o_orderkey:i l_partkey:i l_linenumber:i p_type:s",
    """SELECT o_orderkey, l_partkey, l_linenumber, p_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      JOIN part ON l_partkey = p_partkey""",
)
def j2(spark, sf):
    with_items = J.join_rel(
        table(spark, sf, "orders"), table(spark, sf, "lineitem"), J.JoinSpec(("o_orderkey",), ("l_orderkey",), "inner", "1:N")
    )
    return J.join_rel(with_items, table(spark, sf, "part"), J.JoinSpec(("l_partkey",), ("p_partkey",), "inner", "N:1"))


@bind(
    "j3_full_chain",
    "inc_day:s orders:i items:i sessions:i",
    f"""SELECT inc_day, orders, items, sessions
      FROM (SELECT inc_day, count(*) AS orders FROM {ORDERS} GROUP BY 1)
      FULL JOIN (SELECT inc_day, count(*) AS items FROM {ITEMS} GROUP BY 1) USING (inc_day)
      FULL JOIN (SELECT inc_day, count(*) AS sessions FROM {SESSIONS} GROUP BY 1) USING (inc_day)""",
)
def j3(spark, sf):
    def daily(df, name):
        return df.groupBy("inc_day").agg(F.count(F.lit(1)).alias(name))

    return J.full_join(
        [daily(orders(spark, sf), "orders"), daily(items(spark, sf), "items"), daily(sessions(spark, sf), "sessions")],
        ["inc_day"],
    )


@bind(
    "j4_right_join",
    "o_orderkey:i c_custkey:i c_name:s",
    "SELECT o_orderkey, c_custkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
)
def j4(spark, sf):
    spec = J.JoinSpec(("o_custkey",), ("c_custkey",), "right", "N:1")
    return J.join_rel(table(spark, sf, "orders"), table(spark, sf, "customer"), spec)


@bind(
    "j6_join_dim_filtered",
    "s_suppkey:i s_name:s n_name:s",
    """SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation
      ON s_nationkey = n_nationkey AND n_regionkey = 2""",
)
def j6(spark, sf):
    nation = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.join_dim(table(spark, sf, "supplier"), nation, ["s_nationkey"], "n_regionkey = 2")


@bind(
    "j7_using",
    "order_id:i customer_id:i item_amount:d",
    f"SELECT order_id, customer_id, item_amount FROM {ORDERS} JOIN {ITEMS} USING (order_id)",
)
def j7(spark, sf):
    left = orders(spark, sf).select("order_id", "customer_id")
    return J.join_using(left, items(spark, sf).select("order_id", "item_amount"), ["order_id"])


@bind(
    "j8_join_snapshot",
    "order_id:i inc_day:s pay_amount:d prev_best:d",
    f"""SELECT o.order_id, o.inc_day, o.pay_amount, s.prev_best FROM {ORDERS} o LEFT JOIN
      (SELECT inc_day, priority, max(pay_amount) AS prev_best FROM {ORDERS} WHERE order_status <> '50' GROUP BY ALL) s
      ON o.priority = s.priority AND o.inc_day = s.inc_day""",
)
def j8(spark, sf):
    o = orders(spark, sf)
    snap = o.where("order_status <> '50'").groupBy("inc_day", "priority").agg(F.max("pay_amount").alias("prev_best"))
    return J.join_snapshot(o, snap, ["priority"])


@bind(
    "j9_pushed_filter",
    "o_orderkey:i c_name:s",
    """SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""",
)
def j9(spark, sf):
    # written as filter-over-left-join; the optimizer makes it an inner join with a pushed filter
    spec = J.JoinSpec(("o_custkey",), ("c_custkey",), "left", "N:1")
    joined = J.join_rel(table(spark, sf, "orders"), table(spark, sf, "customer"), spec)
    return joined.where("c_mktsegment = 'BUILDING' AND c_acctbal > 0")


@bind(
    "j10_bridge",
    "order_id:i customer_id:i product_id:i bought_before:i",
    """WITH pairs AS (SELECT o_custkey AS cust, l_partkey AS part, count(*) AS bought_before FROM orders JOIN lineitem
        ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL),
      a AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders),
      b AS (SELECT l_orderkey AS order_id, max(l_partkey) AS product_id FROM lineitem GROUP BY 1)
      SELECT order_id, customer_id, product_id, bought_before FROM a LEFT JOIN b USING (order_id)
      LEFT JOIN pairs ON customer_id = cust AND product_id = part""",
)
def j10(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pairs = (
        o.where("o_orderstatus = 'F'")
        .join(li, o.o_orderkey == li.l_orderkey)
        .groupBy(F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("part"))
        .agg(F.count(F.lit(1)).alias("bought_before"))
    )
    a = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    b = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_partkey").alias("product_id"))
    return J.join_bridge(a, b, ["order_id"], pairs, ("customer_id", "cust"), ("product_id", "part"))


@bind(
    "j11_consecutive_periods",
    "user_id:i day_no:i",
    """WITH p AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day_no FROM events)
      SELECT a.user_id, a.day_no FROM p a JOIN p b ON a.user_id = b.user_id AND a.day_no = b.day_no + 1""",
)
def j11(spark, sf):
    pairs = table(spark, sf, "events").select("user_id", F.unix_date(F.col("ts").cast("date")).alias("day_no"))
    return J.consecutive(pairs, "user_id", "day_no")


@bind(
    "j12_orphans",
    "o_orderkey:i o_custkey:i",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def j12(spark, sf):
    return J.orphans(table(spark, sf, "orders"), table(spark, sf, "lineitem"), ["o_orderkey"], ["l_orderkey"])


@bind(
    "j13_in_scope",
    "o_orderkey:i o_totalprice:d",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN
      (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def j13(spark, sf):
    dim = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    return J.in_scope(table(spark, sf, "orders"), dim, ["o_custkey"], ["c_custkey"])


@bind(
    "j14_latest_available",
    "order_id:i inc_day:s pay_amount:d",
    f"""SELECT order_id, inc_day, pay_amount FROM {ORDERS} WHERE inc_day =
      (SELECT max(inc_day) FROM {ORDERS} WHERE inc_day <= '{BIZDATE}' AND order_status = '20' AND pay_amount > 450000)""",
)
def j14(spark, sf):
    return J.latest_available(orders(spark, sf), BIZDATE, cond="order_status = '20' AND pay_amount > 450000")


@bind(
    "j15_fanout",
    "order_id:i left_rows:i right_rows:i joined_rows:i",
    """SELECT order_id, l AS left_rows, r AS right_rows, l * r AS joined_rows
      FROM (SELECT o_orderkey AS order_id, count(*) AS l FROM orders GROUP BY 1)
      JOIN (SELECT l_orderkey AS order_id, count(*) AS r FROM lineitem GROUP BY 1 HAVING count(*) > 1) USING (order_id)""",
)
def j15(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"))
    right = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return J.fanout(left, right, ["order_id"])


@bind(
    "j8_snapshot_daily_rate",
    "inc_day:s priority:s paid:d best:d",
    f"""SELECT f.inc_day, f.priority, f.paid, d.best FROM
      (SELECT inc_day, priority, sum(pay_amount) AS paid FROM {ORDERS} WHERE order_status IN ('20','30') GROUP BY ALL) f
      LEFT JOIN (SELECT strftime(o_orderdate, '%Y%m%d') AS inc_day, max(CAST(o_totalprice AS DECIMAL(18,2))) AS best FROM orders GROUP BY 1) d
      USING (inc_day)""",
)
def j8b(spark, sf):
    facts = (
        orders(spark, sf).where("order_status IN ('20','30')").groupBy("inc_day", "priority").agg(F.sum("pay_amount").alias("paid"))
    )
    dim = table(spark, sf, "orders").groupBy(day_of("o_orderdate").alias("inc_day")).agg(F.max(money("o_totalprice")).alias("best"))
    return J.join_snapshot(facts, dim, [])
