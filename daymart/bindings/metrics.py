"""Semantic metrics and axioms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..operators import joins as J
from ..operators.quality import duplicate_keys
from ..operators.bitmaps import History
from ..operators.windows import rolling_distinct
from ..plans import domains
from ..plans import semantic as S
from ..session import StageArea
from . import bind
from .frames import (
    ITEMS, MOVES, ORDERS, SESSIONS, SKUS, SNAPSHOTS, items, moves, orders, sessions, skus, snapshots, table,
)
from .windows import DAY_NO

PAID = "order_status IN ('20','30','40')"


@bind(
    "m1_m4_order_metrics",
    "inc_day:s gmv:d order_count:i paid_orders:i pay_rate:d avg_order_value:d",
    f"""SELECT inc_day, sum(pay_amount) FILTER (WHERE {PAID}) AS gmv, count(DISTINCT order_id) AS order_count,
      count(DISTINCT order_id) FILTER (WHERE {PAID}) AS paid_orders,
      CAST(count(DISTINCT order_id) FILTER (WHERE {PAID}) AS DOUBLE) * 100 / count(DISTINCT order_id) AS pay_rate,
      CAST(sum(pay_amount) FILTER (WHERE {PAID}) AS DOUBLE) / NULLIF(count(DISTINCT order_id) FILTER (WHERE {PAID}), 0) AS avg_order_value
      FROM {ORDERS} GROUP BY 1""",
)
def m1(spark, sf):
    names = ["gmv", "order_count", "paid_orders", "pay_rate", "avg_order_value"]
    return S.metric_table(orders(spark, sf), domains.orders_model(), names, ["inc_day"])


def _metric(key: str, metric: str, kind: str, sql: str) -> None:
    @bind(key, f"priority:s {metric}:{kind}", f"SELECT priority, {sql} AS {metric} FROM {ORDERS} GROUP BY 1")
    def run(spark, sf):
        return S.metric_table(orders(spark, sf), domains.orders_model(), [metric], ["priority"])


_metric("m1_gmv", "gmv", "d", f"sum(pay_amount) FILTER (WHERE {PAID})")
_metric("m2_order_count", "order_count", "i", "count(DISTINCT order_id)")
_metric("m3_pay_rate", "pay_rate", "r6", f"CAST(count(DISTINCT order_id) FILTER (WHERE {PAID}) AS DOUBLE) * 100 / count(DISTINCT order_id)")
_metric("m4_avg_order_value", "avg_order_value", "d", f"CAST(sum(pay_amount) FILTER (WHERE {PAID}) AS DOUBLE) / NULLIF(count(DISTINCT order_id) FILTER (WHERE {PAID}), 0)")


@bind("m5_dau", "inc_day:s dau:i", f"SELECT inc_day, count(DISTINCT user_id) AS dau FROM {SESSIONS} GROUP BY 1")
def m5(spark, sf):
    return S.metric_table(sessions(spark, sf), domains.activity_model(), ["dau"], ["inc_day"])


@bind(
    "m6_mau",
    "inc_day:s mau:i",
    f"""WITH a AS (SELECT DISTINCT {DAY_NO} AS d, inc_day, user_id FROM {SESSIONS})
      SELECT x.inc_day, count(DISTINCT y.user_id) AS mau FROM (SELECT DISTINCT d, inc_day FROM a) x
      JOIN a y ON y.d BETWEEN x.d - 29 AND x.d GROUP BY 1""",
)
def m6(spark, sf):
    return rolling_distinct(sessions(spark, sf), "inc_day", "user_id", 30, out="mau")


@bind(
    "m6_mau_history",
    "inc_day:s dau:i mau:i",
    f"""WITH a AS (SELECT DISTINCT {DAY_NO} AS d, inc_day, user_id FROM {SESSIONS})
      SELECT x.inc_day, count(DISTINCT CASE WHEN y.d = x.d THEN y.user_id END) AS dau, count(DISTINCT y.user_id) AS mau FROM (SELECT DISTINCT d, inc_day FROM a) x
      JOIN a y ON y.d BETWEEN x.d - 29 AND x.d GROUP BY 1""",
)
def m6_history(spark, sf):
    """Users of each day and of its 30 days from stored bitmaps; the last days are added later, one of them twice."""
    s = sessions(spark, sf)
    history = History(spark, StageArea(spark, "history").path("users"), s.schema["user_id"].dataType.simpleString(), buckets=2)
    for days in ("inc_day < '20240129'", "inc_day >= '20240129'", "inc_day = '20240129'"):
        history.add(s.where(days), "user_id")
    return history.rolling(1, out="dau").join(history.rolling(30, out="mau"), "inc_day")


@bind(
    "m7_avg_session_duration",
    "inc_day:s avg_session_duration:r6",
    f"""SELECT inc_day, CAST(sum(duration_seconds) FILTER (WHERE duration_seconds > 0) AS DOUBLE)
      / NULLIF(count(*) FILTER (WHERE duration_seconds > 0), 0) AS avg_session_duration FROM {SESSIONS} GROUP BY 1""",
)
def m7(spark, sf):
    return S.metric_table(sessions(spark, sf), domains.activity_model(), ["avg_session_duration"], ["inc_day"])


@bind(
    "m8_feature_penetration",
    "inc_day:s feature_penetration_rate:r6",
    f"""SELECT inc_day, CAST(count(DISTINCT CASE WHEN feature_name = 'purchase' THEN user_id END) AS DOUBLE) * 100
      / count(DISTINCT user_id) AS feature_penetration_rate FROM {SESSIONS} GROUP BY 1""",
)
def m8(spark, sf):
    return S.metric_table(
        sessions(spark, sf), domains.activity_model(), ["feature_penetration_rate"], ["inc_day"], {"target": "purchase"}
    )


STOCK = f"""(SELECT *, stock_quantity - locked_quantity AS available_quantity FROM {SNAPSHOTS} JOIN {SKUS} USING (sku_id))"""


def stock(spark, sf):
    joined = snapshots(spark, sf).join(skus(spark, sf), "sku_id")
    return joined.withColumn("available_quantity", F.col("stock_quantity") - F.col("locked_quantity"))


def _stock_metric(key: str, metric: str, kind: str, sql: str) -> None:
    @bind(key, f"inc_day:s {metric}:{kind}", f"SELECT inc_day, {sql} AS {metric} FROM {STOCK} GROUP BY 1")
    def run(spark, sf):
        return S.metric_table(stock(spark, sf), domains.stock_model(), [metric], ["inc_day"])


_stock_metric("m9_total_stock_value", "total_stock_value", "d", "sum(stock_quantity * unit_cost)")
_stock_metric("m10_stockout_count", "stockout_count", "i", "count(DISTINCT CASE WHEN available_quantity < safety_stock THEN sku_id END)")
_stock_metric("m12_reorder_alert_count", "reorder_alert_count", "i", "count(DISTINCT CASE WHEN available_quantity < reorder_point THEN sku_id END)")


TURNOVER = f"""(SELECT s.warehouse_id, s.sku_id, s.v / m.v AS turnover_days FROM
      (SELECT warehouse_id, sku_id, CAST(sum(stock_quantity) AS DOUBLE) / count(*) AS v FROM {SNAPSHOTS} GROUP BY ALL) s
      LEFT JOIN (SELECT warehouse_id, sku_id, CAST(sum(abs(quantity)) AS DOUBLE) / count(*) AS v FROM {MOVES}
        WHERE lower(movement_type) = 'outbound' GROUP BY ALL) m USING (warehouse_id, sku_id))"""


def turnover(spark, sf):
    return S.turnover_days(snapshots(spark, sf), moves(spark, sf), ["warehouse_id", "sku_id"], "quantity", "stock_quantity")


@bind("m11_turnover_days", "warehouse_id:i sku_id:s turnover_days:r6", f"SELECT * FROM {TURNOVER}")
def m11(spark, sf):
    return turnover(spark, sf)


@bind(
    "m13_metric_alerts",
    "inc_day:s metric:s value:r6 unit:s alert:b level:s",
    f"""WITH w AS (SELECT inc_day, count(DISTINCT order_id) AS n, CAST(count(DISTINCT order_id) FILTER (WHERE {PAID}) AS DOUBLE) * 100
        / count(DISTINCT order_id) AS r FROM {ORDERS} GROUP BY 1)
      SELECT inc_day, 'order_count' AS metric, CAST(n AS DOUBLE) AS value, 'orders' AS unit, FALSE AS alert, 'normal' AS level FROM w
      UNION ALL SELECT inc_day, 'pay_rate', r, '%', r < 70, CASE WHEN r < 70 THEN 'warning' ELSE 'normal' END FROM w""",
)
def m13(spark, sf):
    names = ["order_count", "pay_rate"]
    model = domains.orders_model()
    return S.with_alerts(S.metric_table(orders(spark, sf), model, names, ["inc_day"]), model, names)


@bind(
    "m14_computation_chain",
    "warehouse_id:i sku_id:s inc_day:s available_quantity:d shortfall:d shortfall_value:d",
    f"""SELECT warehouse_id, sku_id, inc_day, available_quantity, greatest(reorder_point - available_quantity, 0) AS shortfall,
      greatest(reorder_point - available_quantity, 0) * unit_cost AS shortfall_value FROM {STOCK}""",
)
def m14(spark, sf):
    base = snapshots(spark, sf).join(skus(spark, sf), "sku_id")
    return S.run_chain(base, domains.stock_model().chains["stock_pressure"])


@bind(
    "m15_derived_attribute",
    "order_id:i tier:s tier_invalid:i",
    f"""SELECT order_id, tier, CASE WHEN tier IN ('gold', 'silver') THEN 0 ELSE 1 END AS tier_invalid FROM (SELECT order_id,
      CASE WHEN pay_amount > 400000 THEN 'gold' WHEN pay_amount > 200000 THEN 'silver' ELSE 'none' END AS tier FROM {ORDERS})""",
)
def m15(spark, sf):
    rules = {"gold": "pay_amount > 400000", "silver": "pay_amount > 200000"}
    return S.derived_attribute(orders(spark, sf), "tier", rules, ["gold", "silver"], "none")


@bind(
    "m16_churn",
    "customer_id:i last_day:s churned:b",
    f"""SELECT customer_id, max(inc_day) AS last_day,
      datediff('day', CAST(strptime(max(inc_day), '%Y%m%d') AS DATE), DATE '2001-08-01') >= 30 AS churned FROM {ORDERS} GROUP BY 1""",
)
def m16(spark, sf):
    return S.churned(orders(spark, sf), "customer_id", "inc_day", "20010801")


@bind(
    "m17_slow_moving",
    "warehouse_id:i sku_id:s slow:i",
    f"SELECT warehouse_id, sku_id, CASE WHEN turnover_days > 3 THEN 1 ELSE 0 END AS slow FROM {TURNOVER}",
)
def m17(spark, sf):
    return turnover(spark, sf).withColumn("slow", S.slow_moving("turnover_days", 3))


@bind(
    "p6_order_status_hierarchy",
    "order_id:i status_class:s",
    f"""SELECT order_id, CASE order_status WHEN '10' THEN 'PendingPayment' WHEN '20' THEN 'Paid' WHEN '30' THEN 'Shipped'
      WHEN '50' THEN 'Cancelled' END AS status_class FROM {ORDERS}""",
)
def hierarchy(spark, sf):
    return orders(spark, sf).withColumn("status_class", S.classify_by(domains.orders_model(), "OrderStatus"))


@bind(
    "j1_model_join_path",
    "order_id:i customer_id:i product_id:i p_type:s",
    f"""SELECT o.order_id, o.customer_id, i.product_id, p_type FROM customer c LEFT JOIN {ORDERS} o ON c.c_custkey = o.customer_id
      JOIN {ITEMS} i ON o.order_id = i.order_id LEFT JOIN part ON i.product_id = p_partkey""",
)
def path(spark, sf):
    it = items(spark, sf)
    frames = {
        "Customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")),
        "Order": orders(spark, sf).select(F.col("order_id"), F.col("customer_id")),
        "OrderItem": it.select("order_id", "product_id"),
        "Product": table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), "p_type"),
    }
    out = S.join_path(domains.orders_model(), frames, ["Customer", "Order", "OrderItem", "Product"])
    return out.select(
        frames["Order"]["order_id"], frames["Order"]["customer_id"], frames["OrderItem"]["product_id"], "p_type"
    )


# --- axioms -------------------------------------------------------------------------


@bind(
    "x1_one_parent",
    "key:i child_rows:i parents:i",
    """SELECT l_orderkey AS key, child_rows, coalesce(n, 0) AS parents FROM (SELECT l_orderkey, count(*) AS child_rows FROM lineitem GROUP BY 1)
      LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE coalesce(n, 0) <> 1""",
)
def x1(spark, sf):
    settled = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return S.one_parent(table(spark, sf, "lineitem"), settled, "l_orderkey", "o_orderkey")


@bind(
    "x2_conservation",
    "key:i total:d parts:d",
    f"""SELECT order_id AS key, pay_amount AS total, coalesce(parts, 0) AS parts FROM {ORDERS} LEFT JOIN
      (SELECT order_id, sum(item_amount) AS parts FROM {ITEMS} GROUP BY 1) USING (order_id) WHERE abs(pay_amount - coalesce(parts, 0)) > 0.01""",
)
def x2(spark, sf):
    return S.conservation(orders(spark, sf), items(spark, sf), "order_id", "order_id", "pay_amount", "item_amount")


@bind(
    "x3_non_negative",
    "source:s negative:i",
    f"""SELECT 'orders' AS source, count(*) AS negative FROM {ORDERS} WHERE pay_amount < 0
      UNION ALL SELECT 'sessions', count(*) FROM {SESSIONS} WHERE duration_seconds < 0
      UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal < 0""",
)
def x3(spark, sf):
    def negatives(df, col, name):
        return df.agg(F.count_if(F.col(col) < 0).alias("negative")).withColumn("source", F.lit(name))

    return (
        negatives(orders(spark, sf), "pay_amount", "orders")
        .unionByName(negatives(sessions(spark, sf), "duration_seconds", "sessions"))
        .unionByName(negatives(table(spark, sf, "customer"), "c_acctbal", "customer"))
    )


@bind(
    "x4_users_in_window",
    "user_id:i inc_day:s",
    f"""WITH a AS (SELECT DISTINCT user_id, {DAY_NO} AS d FROM {SESSIONS} WHERE feature_name = 'view'),
      p AS (SELECT DISTINCT user_id, inc_day, {DAY_NO} AS d FROM {SESSIONS} WHERE feature_name = 'purchase')
      SELECT user_id, inc_day FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = p.user_id AND a.d BETWEEN p.d - 2 AND p.d)""",
)
def x4(spark, sf):
    s = sessions(spark, sf)
    return S.not_in_window(s.where("feature_name = 'purchase'"), s.where("feature_name = 'view'"), "inc_day", "user_id", 3)


@bind(
    "x5_snapshot_unique",
    "warehouse_id:i product_id:i inc_day:s cnt:i",
    """SELECT n_regionkey AS warehouse_id, l_partkey AS product_id, strftime(l_shipdate, '%Y%m%d') AS inc_day, count(*) AS cnt
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 1""",
)
def x5(spark, sf):
    li, su, na = (table(spark, sf, n) for n in ("lineitem", "supplier", "nation"))
    rows = li.join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey)
    snaps = rows.select(
        F.col("n_regionkey").alias("warehouse_id"),
        F.col("l_partkey").alias("product_id"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("inc_day"),
    )
    return duplicate_keys(snaps, ["warehouse_id", "product_id", "inc_day"])


@bind(
    "x5_snapshot_coverage",
    "warehouse_id:i sku_id:s days_present:i days_expected:i days_missing:i",
    f"""SELECT warehouse_id, sku_id, count(*) AS days_present, (SELECT count(DISTINCT inc_day) FROM {SNAPSHOTS}) AS days_expected,
      (SELECT count(DISTINCT inc_day) FROM {SNAPSHOTS}) - count(*) AS days_missing FROM {SNAPSHOTS} GROUP BY ALL""",
)
def x5c(spark, sf):
    return J.grid_gaps(snapshots(spark, sf), ["warehouse_id", "sku_id"], "inc_day")


@bind(
    "x6_available_formula",
    "warehouse_id:i sku_id:s negative_days:i formula_breaks:i",
    f"""SELECT warehouse_id, sku_id, count(*) FILTER (WHERE available_quantity < 0) AS negative_days,
        count(*) FILTER (WHERE inc_day LIKE '%7' OR available_quantity > 900) AS formula_breaks
      FROM {STOCK} GROUP BY ALL""",
)
def x6(spark, sf):
    # what a loader stored: it lost a unit on days that end in 7 and cut large values
    loaded = F.least(F.col("available_quantity"), F.lit(900)) - F.when(F.col("inc_day").endswith("7"), 1).otherwise(0)
    stored = StageArea(spark, "stock").save(stock(spark, sf).withColumn("stored_available", loaded))
    gap = F.abs(F.col("stored_available") - (F.col("stock_quantity") - F.col("locked_quantity")))
    return stored.groupBy("warehouse_id", "sku_id").agg(
        F.count_if(F.col("available_quantity") < 0).alias("negative_days"), F.count_if(gap > 0).alias("formula_breaks")
    )


@bind(
    "x7_adjustment_reference",
    "warehouse_id:i adjustments:i without_reference:i share:r6",
    f"""SELECT warehouse_id, count(*) AS adjustments, count(*) FILTER (WHERE reference_no IS NULL) AS without_reference,
      CAST(count(*) FILTER (WHERE reference_no IS NULL) AS DOUBLE) / count(*) AS share
      FROM {MOVES} WHERE movement_type = 'adjustment' GROUP BY 1""",
)
def x7(spark, sf):
    missing = F.count_if(F.col("reference_no").isNull())
    return (
        moves(spark, sf)
        .where("movement_type = 'adjustment'")
        .groupBy("warehouse_id")
        .agg(F.count(F.lit(1)).alias("adjustments"), missing.alias("without_reference"), safe_div(missing, F.count(F.lit(1))).alias("share"))
    )
