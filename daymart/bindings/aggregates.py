"""Aggregates, small reports and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import money
from ..operators import aggs as A
from ..operators import sets as U
from ..operators import topk as T
from ..plans.marts import commerce_daily, commerce_daily_with_refunds
from . import bind
from .frames import ITEMS, ORDERS, items, orders, table


@bind(
    "a1_group_aggregates",
    "return_flag:s line_status:s rows:i qty:d amount:d avg_qty:r6 min_amount:d max_amount:d",
    f"""SELECT return_flag, line_status, count(*) AS rows, sum(quantity) AS qty, sum(item_amount) AS amount,
      CAST(sum(quantity) AS DOUBLE) / count(*) AS avg_qty, min(item_amount) AS min_amount, max(item_amount) AS max_amount
      FROM {ITEMS} GROUP BY ALL""",
)
def a1(spark, sf):
    return (
        items(spark, sf)
        .groupBy("return_flag", "line_status")
        .agg(
            A.count_rows().alias("rows"),
            F.sum("quantity").alias("qty"),
            F.sum("item_amount").alias("amount"),
            A.ratio(F.sum("quantity"), A.count_rows()).alias("avg_qty"),
            F.min("item_amount").alias("min_amount"),
            F.max("item_amount").alias("max_amount"),
        )
    )


@bind(
    "a2_count_distinct",
    "supplier_id:i orders:i products:i",
    f"SELECT supplier_id, count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS products FROM {ITEMS} GROUP BY 1",
)
def a2(spark, sf):
    return items(spark, sf).groupBy("supplier_id").agg(
        F.count_distinct("order_id").alias("orders"), F.count_distinct("product_id").alias("products")
    )


@bind(
    "a3_conditional",
    "priority:s paid_orders:i paid_amount:d",
    f"""SELECT priority, count(*) FILTER (WHERE order_status IN ('20','30','40')) AS paid_orders,
      sum(CASE WHEN order_status IN ('20','30','40') THEN pay_amount END) AS paid_amount FROM {ORDERS} GROUP BY 1""",
)
def a3(spark, sf):
    paid = "order_status IN ('20','30','40')"
    return orders(spark, sf).groupBy("priority").agg(
        A.count_when(paid).alias("paid_orders"), A.sum_when(paid, "pay_amount").alias("paid_amount")
    )


@bind(
    "a4_conditional_distinct",
    "inc_month:s payers:i cancellers:i",
    f"""SELECT substr(inc_day, 1, 6) AS inc_month, count(DISTINCT CASE WHEN order_status = '20' THEN customer_id END) AS payers,
      count(DISTINCT CASE WHEN order_status = '50' THEN customer_id END) AS cancellers FROM {ORDERS} GROUP BY 1""",
)
def a4(spark, sf):
    return orders(spark, sf).groupBy(F.substring("inc_day", 1, 6).alias("inc_month")).agg(
        A.distinct_when("order_status = '20'", "customer_id").alias("payers"),
        A.distinct_when("order_status = '50'", "customer_id").alias("cancellers"),
    )


@bind(
    "a5_ratio",
    "inc_day:s pay_rate:r6",
    f"""SELECT inc_day, count(*) FILTER (WHERE order_status IN ('20','30')) * 100.0 / NULLIF(count(DISTINCT order_id), 0) AS pay_rate
      FROM {ORDERS} GROUP BY 1""",
)
def a5(spark, sf):
    rate = A.ratio(A.count_when("order_status IN ('20','30')"), F.count_distinct("order_id"), percent=True)
    return orders(spark, sf).groupBy("inc_day").agg(rate.alias("pay_rate"))


@bind(
    "a6_having",
    "order_id:i line_no:i cnt:i",
    f"SELECT order_id, line_no, count(*) AS cnt FROM {ITEMS} GROUP BY ALL HAVING count(*) > 1",
)
def a6(spark, sf):
    return A.having(items(spark, sf), ["order_id", "line_no"], {"cnt": A.count_rows()}, "cnt > 1")


@bind(
    "a7_list_agg_distinct",
    "supplier_id:i flags:s",
    """SELECT l_suppkey AS supplier_id, string_agg(DISTINCT l_linestatus || l_returnflag || CAST(l_linenumber AS VARCHAR), ','
      ORDER BY l_linestatus || l_returnflag || CAST(l_linenumber AS VARCHAR)) AS flags FROM lineitem GROUP BY 1""",
)
def a7(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("supplier_id"), F.concat("l_linestatus", "l_returnflag", "l_linenumber").alias("f")
    )
    return A.list_agg_distinct(rows, ["supplier_id"], "f", "flags")


@bind(
    "a8_single_or_null",
    "order_id:i only_flag:s only_status:s",
    f"""SELECT order_id, CASE WHEN count(DISTINCT return_flag) = 1 THEN max(return_flag) END AS only_flag,
      CASE WHEN count(DISTINCT line_status) = 1 THEN max(line_status) END AS only_status FROM {ITEMS} GROUP BY 1""",
)
def a8(spark, sf):
    return items(spark, sf).groupBy("order_id").agg(
        A.single_or_null("return_flag").alias("only_flag"), A.single_or_null("line_status").alias("only_status")
    )


@bind(
    "a9_daily_avg",
    "priority:s daily_avg:r2",
    f"""SELECT priority, CAST(sum(pay_amount) AS DOUBLE) / count(DISTINCT inc_day) AS daily_avg FROM {ORDERS} GROUP BY 1""",
)
def a9(spark, sf):
    return orders(spark, sf).groupBy("priority").agg(A.daily_avg("pay_amount", "inc_day", 6).alias("daily_avg"))


@bind(
    "a10_single_pass",
    "supplier_id:i returned:d shipped:d single_flag:s open_orders:i",
    f"""SELECT supplier_id, sum(CASE WHEN return_flag = 'R' THEN item_amount END) AS returned,
      sum(CASE WHEN line_status = 'F' THEN item_amount END) AS shipped,
      CASE WHEN count(DISTINCT return_flag) = 1 THEN max(return_flag) END AS single_flag,
      count(DISTINCT CASE WHEN line_status = 'O' THEN order_id END) AS open_orders FROM {ITEMS} GROUP BY 1""",
)
def a10(spark, sf):
    return items(spark, sf).groupBy("supplier_id").agg(
        A.sum_when("return_flag = 'R'", "item_amount").alias("returned"),
        A.sum_when("line_status = 'F'", "item_amount").alias("shipped"),
        A.single_or_null("return_flag").alias("single_flag"),
        A.distinct_when("line_status = 'O'", "order_id").alias("open_orders"),
    )


@bind(
    "a11_with_totals",
    "priority:s order_status:s level:i orders:i amount:d",
    f"""SELECT priority, order_status, CAST(grouping(priority) + grouping(order_status) AS BIGINT) AS level,
      count(*) AS orders, sum(pay_amount) AS amount FROM {ORDERS} GROUP BY ROLLUP (priority, order_status)""",
)
def a11(spark, sf):
    return A.with_totals(
        orders(spark, sf), ["priority", "order_status"], {"orders": A.count_rows(), "amount": F.sum("pay_amount")}
    )


@bind(
    "a12_null_safe_sum",
    "c_custkey:i amount:d",
    """SELECT c_custkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS amount
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
)
def a12(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(money("o_totalprice")).alias("a"))
    joined = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return joined.groupBy("c_custkey").agg(A.sum0("a").alias("amount"))


@bind("t1_latest_partition", "latest_partition:s", f"SELECT max(inc_day) AS latest_partition FROM {ORDERS}")
def t1(spark, sf):
    return T.latest_partition(orders(spark, sf))


@bind(
    "t2_top_values",
    "value:s cnt:i",
    "SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS cnt FROM lineitem GROUP BY l_partkey ORDER BY cnt DESC, l_partkey LIMIT 10",
)
def t2(spark, sf):
    return T.top_values(table(spark, sf, "lineitem"), "l_partkey", 10)


@bind(
    "u1_union",
    "key:i amount:d",
    """SELECT o_orderkey AS key, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders
      UNION ALL SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) FROM lineitem""",
)
def u1(spark, sf):
    a = orders(spark, sf).select(F.col("order_id").alias("key"), F.col("pay_amount").alias("amount"))
    b = items(spark, sf).select(F.col("item_amount").alias("amount"), F.col("order_id").alias("key"))
    return U.union_like([a, b])


@bind(
    "u1_union_distinct",
    "user_key:i",
    "SELECT o_custkey AS user_key FROM orders UNION SELECT c_custkey FROM customer",
)
def u1d(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_key"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_key"))
    return U.union_like([a, b], distinct=True)


@bind(
    "u2_line_diff",
    "doc_id:i added_lines:i removed_lines:i total_changed:i",
    r"""WITH v AS (SELECT doc_id, list_distinct(string_split_regex(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) AS o,
        list_distinct(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '^\s+|\s+$', '', 'g'), '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) AS n FROM documents),
      d AS (SELECT doc_id, len(list_filter(n, lambda x: NOT list_contains(o, x))) AS a, len(list_filter(o, lambda x: NOT list_contains(n, x))) AS r FROM v)
      SELECT doc_id, a AS added_lines, r AS removed_lines, a + r AS total_changed FROM d""",
)
def u2(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", "text")
    return U.line_diff(old, old.withColumn("text", F.regexp_replace("text", "[0-9]", "#")), "doc_id")


@bind(
    "u3_diff_datasets",
    "inc_day:s old_rows:i new_rows:i state:s",
    f"""WITH o AS (SELECT inc_day, count(*) AS n, sum(pay_amount) AS a FROM {ORDERS} WHERE order_status IN ('20','30','40') GROUP BY 1),
      c AS (SELECT inc_day, count(*) AS n, sum(pay_amount) AS a FROM {ORDERS} WHERE order_status >= '20' GROUP BY 1)
      SELECT coalesce(o.inc_day, c.inc_day) AS inc_day, CASE WHEN o.inc_day IS NULL THEN 0 ELSE 1 END AS old_rows,
      CASE WHEN c.inc_day IS NULL THEN 0 ELSE 1 END AS new_rows,
      CASE WHEN o.inc_day IS NULL THEN 'added' WHEN c.inc_day IS NULL THEN 'removed'
           WHEN o.n = c.n AND o.a = c.a THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN c USING (inc_day)""",
)
def u3(spark, sf):
    def daily(cond):
        return orders(spark, sf).where(cond).groupBy("inc_day").agg(A.count_rows().alias("n"), F.sum("pay_amount").alias("a"))

    return U.diff_datasets(daily("order_status IN ('20','30','40')"), daily("order_status >= '20'"), ["inc_day"], ["n", "a"])


@bind(
    "u3_metric_regression",
    "state:s days:i",
    f"""WITH r AS (SELECT DISTINCT inc_day FROM {ITEMS} WHERE return_flag = 'R'),
      b AS (SELECT DISTINCT inc_day FROM {ORDERS} WHERE order_status IN ('20','30','40'))
      SELECT CASE WHEN b.inc_day IS NULL THEN 'added' ELSE 'same' END AS state, count(*) AS days
      FROM b FULL JOIN r USING (inc_day) GROUP BY 1""",
)
def u3b(spark, sf):
    # the mart before and after adding refunds: days with orders stay the same
    o, paid = orders(spark, sf), "order_status IN ('20','30','40')"
    refunds = items(spark, sf).select("order_id", "inc_day", F.col("item_amount").alias("refund_amount"), "return_flag")
    new = commerce_daily_with_refunds(o, paid, refunds, "return_flag = 'R'")
    old = commerce_daily(o, paid)
    diff = U.diff_datasets(old, new, ["inc_day"], ["order_count", "customer_count", "gmv", "avg_order_amount"])
    return diff.groupBy("state").agg(F.count(F.lit(1)).alias("days"))


@bind(
    "u3_multiset_diff",
    "l_orderkey:i l_linenumber:i side:s",
    """SELECT *, 'old' AS side FROM (SELECT l_orderkey, l_linenumber FROM lineitem EXCEPT ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def u3c(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return U.multiset_diff(rows, rows.distinct())


@bind(
    "u3_diff_by_digest",
    "l_orderkey:i l_linenumber:i l_quantity:d old_rows:i new_rows:i",
    """WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_orderkey % 1500 <> 11),
      s AS (SELECT l_orderkey, l_linenumber, l_quantity, 1 AS o, 0 AS n FROM lineitem UNION ALL SELECT *, 0, 1 FROM n)
      SELECT l_orderkey, l_linenumber, l_quantity, sum(o) AS old_rows, sum(n) AS new_rows FROM s GROUP BY 1, 2, 3 HAVING sum(o) <> sum(n)""",
)
def u3d(spark, sf):
    """An output against a later one in which a few orders changed or are gone."""
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    quantity = F.when(F.col("l_orderkey") % 1000 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    new = old.where("l_orderkey % 1500 <> 11").withColumn("l_quantity", quantity)
    return U.diff_by_digest(old, new, ["l_orderkey"])


@bind(
    "u4_merge_insert_only",
    "cust_key:i label:s",
    """SELECT c_custkey AS cust_key, c_mktsegment AS label FROM customer WHERE c_acctbal > 0
      UNION ALL SELECT o_custkey, min(o_orderpriority) FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""",
)
def u4(spark, sf):
    current = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust_key"), F.col("c_mktsegment").alias("label"))
    updates = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust_key"), F.col("o_orderpriority").alias("label"))
    return U.merge_insert_only(current, updates, ["cust_key"], ["label"])


@bind(
    "u5_changed",
    "conv_id:i turn:i hash:s changed:b",
    r"""WITH n AS (SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n{3,}', E'\n\n', 'g')) AS hash,
        sha256(regexp_replace(regexp_replace(replace(text, '.', ''), '^\s+|\s+$', '', 'g'), '\n{3,}', E'\n\n', 'g')) AS prev, role FROM conversations)
      SELECT conv_id, turn, hash, CASE WHEN role = 'system' THEN TRUE ELSE hash <> prev END AS changed FROM n""",
)
def u5(spark, sf):
    now = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    before = now.where("role <> 'system'").withColumn("text", F.translate("text", ".", ""))
    out = U.changed(now, before, "key")
    return out.select("key.conv_id", "key.turn", "hash", "changed")
