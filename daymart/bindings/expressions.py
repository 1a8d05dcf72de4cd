"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import days, exprs
from ..plans.model import FilterRule
from ..plans.semantic import apply_filter_rules
from . import bind
from .frames import BIZDATE, ITEMS, ORDERS, items, orders, table


@bind("p1_project", "order_id:i inc_day:s pay_amount:d", f"SELECT order_id, inc_day, pay_amount FROM {ORDERS}")
def p1(spark, sf):
    return exprs.project(orders(spark, sf), ["order_id", "inc_day", "pay_amount"])


@bind(
    "p2_safe_div",
    "order_id:i product_id:i item_amount:d zero_guard:r6 positive_guard:r4",
    f"""SELECT order_id, product_id, item_amount,
      CAST(item_amount AS DOUBLE) / NULLIF(CAST(discount AS DOUBLE), 0) AS zero_guard,
      CASE WHEN discount - 0.05 > 0 THEN CAST(item_amount AS DOUBLE) / CAST(discount - 0.05 AS DOUBLE) END AS positive_guard
      FROM {ITEMS}""",
)
def p2(spark, sf):
    return items(spark, sf).select(
        "order_id",
        "product_id",
        "item_amount",
        exprs.safe_div("item_amount", "discount").alias("zero_guard"),
        exprs.safe_div("item_amount", F.expr("discount - 0.05"), positive=True).alias("positive_guard"),
    )


@bind(
    "p3_fill_defaults",
    "c_custkey:i last_total:d last_priority:s",
    """SELECT c_custkey, coalesce(o_totalprice, 0) AS last_total, coalesce(o_orderpriority, '') AS last_priority
      FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS o_totalprice,
        max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def p3(spark, sf):
    last = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.max_by("o_totalprice", "o_orderkey").alias("last_total"),
            F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"),
        )
    )
    joined = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return exprs.fill_defaults(joined, ["last_total", "last_priority"])


@bind(
    "p4_conform",
    "o_orderkey:s o_totalprice:d o_year:i prio:i",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS DECIMAL(18,1)) AS o_totalprice,
      year(o_orderdate) AS o_year, TRY_CAST(o_orderpriority AS BIGINT) AS prio FROM orders""",
)
def p4(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("o_year"), F.col("o_orderpriority").alias("prio")
    )
    schema = StructType.fromDDL("o_orderkey string, o_totalprice decimal(18,1), o_year bigint, prio bigint")
    return exprs.conform(rows, schema, dirty=True)


@bind(
    "p5_decode_enum",
    "order_id:i status_label:s",
    f"""SELECT order_id, CASE order_status WHEN '10' THEN 'pending' WHEN '20' THEN 'paid' WHEN '50' THEN 'cancelled'
      ELSE 'unknown' END AS status_label FROM {ORDERS}""",
)
def p5(spark, sf):
    label = exprs.decode_enum("order_status", {"10": "pending", "20": "paid", "50": "cancelled"}, "unknown")
    return orders(spark, sf).select("order_id", label.alias("status_label"))


@bind(
    "p6_classify",
    "order_id:i size_class:s",
    f"""SELECT order_id, CASE WHEN pay_amount >= 400000 THEN 'large' WHEN pay_amount >= 100000 THEN 'middle'
      WHEN order_status = '50' THEN 'small-cancelled' ELSE 'small' END AS size_class FROM {ORDERS}""",
)
def p6(spark, sf):
    rules = {"large": "pay_amount >= 400000", "middle": "pay_amount >= 100000", "small-cancelled": "order_status = '50'"}
    return orders(spark, sf).select("order_id", exprs.classify(rules, "small").alias("size_class"))


@bind(
    "p7_day_predicates",
    "kind:s rows:i amount:d",
    f"""SELECT 'between' AS kind, count(*) AS rows, sum(pay_amount) AS amount FROM {ORDERS} WHERE inc_day BETWEEN '19980601' AND '19980630'
      UNION ALL SELECT 'eq', count(*), sum(pay_amount) FROM {ORDERS} WHERE inc_day = '{BIZDATE}'
      UNION ALL SELECT 'in', count(*), sum(pay_amount) FROM {ORDERS} WHERE inc_day IN ('19980601', '19980602')""",
)
def p7(spark, sf):
    # one scan: the union of the three day sets is pushed as a timestamp range
    scan = table(spark, sf, "orders").where(days.ts_between_days("o_orderdate", "19980601", "19980630"))
    rows = scan.select(days.day_of("o_orderdate").alias("d"), exprs.money("o_totalprice").alias("a"))
    kinds = {
        "between": days.day_between("d", "19980601", "19980630"),
        "eq": days.day_eq("d", BIZDATE),
        "in": days.day_in("d", ["19980601", "19980602"]),
    }
    wide = rows.agg(
        *[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()],
        *[F.sum(F.when(c, F.col("a"))).alias(f"a_{k}") for k, c in kinds.items()],
    )
    return wide.select(
        F.inline(
            F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("rows"), F.col(f"a_{k}").alias("amount")) for k in kinds])
        )
    )


@bind(
    "p8_date_macro",
    "inc_day:s orders:i",
    f"""SELECT inc_day, count(*) AS orders FROM {ORDERS}
      WHERE inc_day BETWEEN strftime(date_trunc('week', DATE '1998-06-15'), '%Y%m%d') AND '19980615'
         OR inc_day = strftime(DATE '1998-06-15' - INTERVAL 29 DAY, '%Y%m%d') GROUP BY inc_day""",
)
def p8(spark, sf):
    cond = days.resolve_macro(
        "inc_day BETWEEN '$[monday(yyyyMMdd,-1d)]' AND '${bizdate}' OR inc_day = '$[time(yyyyMMdd,-30d)]'", BIZDATE
    )
    return orders(spark, sf, ("19980517", BIZDATE)).where(cond).groupBy("inc_day").agg(F.count(F.lit(1)).alias("orders"))


@bind(
    "p9_year_window",
    "inc_day:s amount:d",
    f"""SELECT inc_day, sum(pay_amount) AS amount FROM {ORDERS}
      WHERE inc_day BETWEEN '19980101' AND '{BIZDATE}' GROUP BY inc_day""",
)
def p9(spark, sf):
    return orders(spark, sf, ("19980101", BIZDATE)).where(days.year_window("inc_day", BIZDATE)).groupBy("inc_day").agg(F.sum("pay_amount").alias("amount"))


@bind(
    "p10_filter_rules",
    "customer_id:i order_id:i pay_amount:d",
    f"""SELECT customer_id, order_id, pay_amount FROM {ORDERS}
      WHERE inc_day BETWEEN '19980101' AND '{BIZDATE}' AND order_status != '50' AND pay_amount > 0
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_time DESC, order_id) = 1""",
)
def p10(spark, sf):
    rules = [
        FilterRule(partition="inc_day BETWEEN '19980101' AND '$[time(yyyyMMdd,-1d)]'"),
        FilterRule(
            conditions=("order_status != '50'", "pay_amount > 0"),
            dedup_keys=("customer_id",),
            dedup_order=("order_time desc", "order_id"),
        ),
    ]
    return apply_filter_rules(orders(spark, sf, ("19980101", BIZDATE)), rules, BIZDATE)


@bind(
    "p11_scenario_flags",
    "order_id:i order_status:s pay_amount:d is_s1:i is_s2:i is_s3:i",
    f"""SELECT * FROM (SELECT order_id, order_status, pay_amount,
      CASE WHEN order_status = '50' AND pay_amount > 300000 THEN 1 ELSE 0 END AS is_s1,
      CASE WHEN priority = '1-URGENT' AND order_status = '10' THEN 1 ELSE 0 END AS is_s2,
      CASE WHEN inc_day LIKE '1998%' AND pay_amount < 5000 THEN 1 ELSE 0 END AS is_s3 FROM {ORDERS})
      WHERE is_s1 = 1 OR is_s2 = 1 OR is_s3 = 1""",
)
def p11(spark, sf):
    conds = {
        "s1": "order_status = '50' AND pay_amount > 300000",
        "s2": "priority = '1-URGENT' AND order_status = '10'",
        "s3": "inc_day LIKE '1998%' AND pay_amount < 5000",
    }
    return exprs.scenario_flags(orders(spark, sf), conds).where(exprs.any_scenario(conds))


@bind(
    "p12_join_key",
    "nation:s orders:i amount:d",
    """SELECT n_name AS nation, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
      FROM (SELECT o.*, CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(c_nationkey, 0) ELSE o_orderkey % 25 END AS nk
            FROM orders o LEFT JOIN customer ON o_custkey = c_custkey)
      LEFT JOIN nation ON nk = n_nationkey GROUP BY n_name""",
)
def p12(spark, sf):
    base = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"), "left")
    keyed = exprs.with_join_key(
        base, "n_nationkey", "CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(c_nationkey, 0) ELSE o_orderkey % 25 END"
    )
    # reduce to one row per key before the names are joined in
    reduced = keyed.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(exprs.money("o_totalprice")).alias("a"))
    named = reduced.join(table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint"), "n_name"), "n_nationkey", "left")
    return named.groupBy(F.col("n_name").alias("nation")).agg(F.sum("n").alias("orders"), F.sum("a").alias("amount"))


@bind(
    "p13_clamp",
    "event_id:i value:d value_clamped:i",
    """SELECT event_id, least(greatest(value, 1.0), 100.0) AS value,
      CASE WHEN value < 1.0 OR value > 100.0 THEN 1 ELSE 0 END AS value_clamped FROM events""",
)
def p13(spark, sf):
    return exprs.clamp(table(spark, sf, "events"), "value", 1.0, 100.0)


@bind(
    "p14_ieq",
    "p_partkey:i p_type:s",
    "SELECT p_partkey, p_type FROM part WHERE lower(p_type) = lower('eCoNoMy')",
)
def p14(spark, sf):
    return table(spark, sf, "part").where(exprs.ieq("p_type", F.lit("eCoNoMy")))


@bind(
    "p15_derive",
    "order_id:i product_id:i discount_amount:d net_amount:d",
    f"""SELECT order_id, product_id, CAST(item_amount * discount AS DECIMAL(18,2)) AS discount_amount,
      item_amount - CAST(item_amount * discount AS DECIMAL(18,2)) AS net_amount FROM {ITEMS}""",
)
def p15(spark, sf):
    return exprs.derive(
        items(spark, sf),
        {
            "discount_amount": "CAST(item_amount * discount AS DECIMAL(18,2))",
            "net_amount": "item_amount - discount_amount",
        },
    )
