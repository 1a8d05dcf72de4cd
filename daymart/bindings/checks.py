"""Quality checks, roll-ups and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import quality as Q
from ..operators.scripts import column_lineage, targets_and_sources
from ..operators.topk import failures_first
from ..plans.marts import commerce_daily
from . import bind
from .frames import BIZDATE, ITEMS, ORDERS, SCRIPTS, SESSIONS, items, orders, scripts, table

MEASURED = "category:s name:s weight:i measured:r6 threshold:s status:s"


def one(category: str, name: str, measured: str, weight: int, threshold: str, abnormal: str) -> str:
    """SQL of one evaluated check; ``abnormal`` is a predicate on m."""
    return f"""SELECT '{category}' AS category, '{name}' AS name, {weight} AS weight, m AS measured, '{threshold}' AS threshold,
      CASE WHEN m IS NULL THEN 'SKIPPED' WHEN {abnormal} THEN 'FAILED' ELSE 'PASSED' END AS status
      FROM (SELECT CAST(({measured}) AS DOUBLE) AS m)"""


@bind(
    "q1_duplicate_keys",
    "order_id:i line_no:i cnt:i",
    f"SELECT order_id, line_no, count(*) AS cnt FROM {ITEMS} GROUP BY ALL HAVING count(*) > 1",
)
def q1(spark, sf):
    return Q.duplicate_keys(items(spark, sf), ["order_id", "line_no"])


Q1 = one("uniqueness", "item line", f"SELECT count(*) FROM (SELECT 1 FROM {ITEMS} GROUP BY order_id, line_no HAVING count(*) > 1)", 30, ">0", "m > 0")
Q2 = one("uniqueness", "order columns not null", f"SELECT count(*) FROM {ORDERS} WHERE order_id IS NULL OR customer_id IS NULL OR pay_amount IS NULL", 30, ">0", "m > 0")
Q3 = one("timeliness", "orders fresh", f"SELECT datediff('day', CAST(strptime(max(inc_day), '%Y%m%d') AS DATE), DATE '2001-08-02') FROM {ORDERS}", 30, "!=0", "m <> 0")
Q4 = one("consistency", "net amount formula", f"SELECT count(*) FROM (SELECT item_amount - CAST(item_amount * discount AS DECIMAL(18,2)) AS net, CAST(item_amount * (1 - discount) AS DECIMAL(18,1)) AS other FROM {ITEMS}) WHERE abs(net - other) > 0.01", 30, ">0", "m > 0")
Q5 = one("refutation", "cancelled order above 490000", f"SELECT count(*) FROM {ORDERS} WHERE order_status = '50' AND pay_amount > 490000", 15, ">0", "m > 0")
Q6 = one("consistency", "orders against their items", "SELECT abs((SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem)) / CAST((SELECT count(DISTINCT l_orderkey) FROM lineitem) AS DOUBLE)", 15, ">1%", "m > 0.01")
Q7 = one("consistency", "orders with no items", "SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))", 15, ">0", "m > 0")
Q8 = one("boundary", "quantity range", f"SELECT CAST(count(*) FILTER (WHERE quantity < 2 OR quantity > 45) AS DOUBLE) / count(*) FROM {ITEMS}", 15, ">10%", "m > 0.1")
Q9 = one("boundary", "blank priority", f"SELECT count(*) FROM {ORDERS} WHERE priority IS NULL OR trim(priority) = ''", 5, ">0", "m > 0")
Q10 = one("boundary", "priority format", f"SELECT count(*) FROM {ORDERS} WHERE NOT regexp_matches(priority, '^[1-5]-[A-Z]+$')", 5, ">0", "m > 0")
Q11 = one("fluctuation", "day volume", f"SELECT abs(a - b) / NULLIF(b, 0) FROM (SELECT CAST(count(*) FILTER (WHERE inc_day = '{BIZDATE}') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE inc_day = '19980614') AS DOUBLE) AS b FROM {ORDERS})", 5, ">50%", "m > 0.5")


def order_checks() -> list[Q.Check]:
    return [
        Q.Check("uniqueness", "order columns not null", "orders", Q.nulls(["order_id", "customer_id", "pay_amount"]), weight="High"),
        Q.Check("timeliness", "orders fresh", "orders", Q.stale_days("inc_day", "20010802"), weight="High", threshold="!=0"),
        Q.Check("refutation", "cancelled order above 490000", "orders", Q.breaks("order_status = '50' AND pay_amount > 490000")),
        Q.Check("boundary", "blank priority", "orders", Q.blanks("priority"), weight="Low"),
        Q.Check("boundary", "priority format", "orders", Q.unmatched("priority", "^[1-5]-[A-Z]+$"), weight="Low"),
        Q.Check("fluctuation", "day volume", "orders", Q.day_volume_change("inc_day", BIZDATE), weight="Low", threshold=">50%",
                where=f"inc_day BETWEEN '19980614' AND '{BIZDATE}'", ratio=True),
    ]


def item_checks() -> list[Q.Check]:
    net = "item_amount - CAST(item_amount * discount AS DECIMAL(18,2))"
    return [
        Q.Check("consistency", "net amount formula", "items", Q.formula(net, "CAST(item_amount * (1 - discount) AS DECIMAL(18,1))"), weight="High"),
        Q.Check("boundary", "quantity range", "items", Q.out_of_range("quantity", 2, 45), threshold=">10%"),
    ]


def table_checks() -> list[Q.Check]:
    return [
        Q.Check("uniqueness", "item line", frame=Q.unique("items", ["order_id", "line_no"]), weight="High"),
        Q.Check("consistency", "orders against their items", frame=Q.count_gap("orders", "item_orders"), threshold=">1%"),
        Q.Check("consistency", "orders with no items", frame=Q.misaligned("orders", ["order_id"], "items")),
    ]


def sources(spark, sf):
    it = items(spark, sf)
    return {"orders": orders(spark, sf), "items": it, "item_orders": it.select("order_id").distinct()}


def _bind_single(key: str, name: str, sql: str) -> None:
    @bind(key, MEASURED, sql)
    def run(spark, sf):
        check = next(c for c in order_checks() + item_checks() + table_checks() if c.name == name)
        return Q.suite(sources(spark, sf), [check])


for _key, _name, _sql in (
    ("q2_not_null", "order columns not null", Q2),
    ("q3_freshness", "orders fresh", Q3),
    ("q4_formula", "net amount formula", Q4),
    ("q5_refutation", "cancelled order above 490000", Q5),
    ("q6_count_reconciliation", "orders against their items", Q6),
    ("q7_dimension_alignment", "orders with no items", Q7),
    ("q8_extreme_value", "quantity range", Q8),
    ("q9_not_blank", "blank priority", Q9),
    ("q10_format", "priority format", Q10),
    ("q11_volume_change", "day volume", Q11),
):
    _bind_single(_key, _name, _sql)


@bind(
    "q12_volume_band",
    "inc_day:s cnt:i prev_cnt:i pct_change:r2",
    f"""WITH d AS (SELECT inc_day, count(*) AS cnt FROM {ORDERS} WHERE inc_day BETWEEN '19980608' AND '{BIZDATE}' GROUP BY 1),
      s AS (SELECT inc_day, cnt, lag(cnt) OVER (ORDER BY inc_day) AS prev_cnt FROM d)
      SELECT *, round((cnt - prev_cnt) * 100.0 / prev_cnt, 2) AS pct_change FROM s WHERE abs(round((cnt - prev_cnt) * 100.0 / prev_cnt, 2)) > 30""",
)
def q12(spark, sf):
    return Q.volume_band(orders(spark, sf, ("19980608", BIZDATE)), "inc_day", BIZDATE)


STREAM_BAND = 5


def volume_run(spark, sf, tag):
    """Events as a stream in two runs; the second one also brings rows of the first one's last hour, late but in time."""
    from pyspark.sql.types import StructField, StructType, TimestampType

    from ..session import StageArea
    from ..streaming import volume

    area = StageArea(spark, tag)
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    late = F.col("ts") >= "2024-01-14 23:00:00"
    out, files = area.path("out"), area.path("files")
    schema = StructType([StructField("ts", TimestampType())])

    def suite(day):
        return [volume.volume_change(day), volume.days_out_of_band(day, 30, STREAM_BAND / 100)]

    for rows in (events.where(~late), events.where(late)):
        rows.write.mode("append").parquet(files)
        stream = spark.readStream.schema(schema).parquet(files)
        volume.run_volume_stream(volume.volume_stream(stream, "ts", "1 hour"), out, area.path("checkpoint"), suite)
    return out


VOLUMES = f"""(SELECT inc_day, cnt, lag(cnt) OVER (ORDER BY inc_day) AS prev_cnt, round((cnt - lag(cnt) OVER (ORDER BY inc_day)) * 100.0 / lag(cnt) OVER (ORDER BY inc_day), 2) AS pct_change
  FROM (SELECT inc_day, count(*) AS cnt FROM {SESSIONS} GROUP BY 1))"""


@bind("q12_volume_stream", "inc_day:s cnt:i prev_cnt:i pct_change:r2", f"SELECT * FROM {VOLUMES}")
def q12_stream(spark, sf):
    from ..operators.windows import period_change
    from ..streaming import volume

    return period_change(volume.volumes(spark, volume_run(spark, sf, "volumes")), "inc_day", "cnt")


@bind(
    "q11_volume_stream_checks",
    "name:s measured:r6 status:s",
    f"""WITH v AS (SELECT * FROM {VOLUMES}), n AS (SELECT arg_max(abs(cnt - prev_cnt) / CAST(prev_cnt AS DOUBLE), inc_day) AS m, max(inc_day) AS d FROM v),
      b AS (SELECT count(*) AS m FROM v WHERE abs(pct_change) > {STREAM_BAND})
      SELECT 'volume of ' || d AS name, m AS measured, CASE WHEN m > 0.5 THEN 'FAILED' ELSE 'PASSED' END AS status FROM n
      UNION ALL SELECT 'days out of band up to ' || d, CAST(b.m AS DOUBLE), CASE WHEN b.m > 0 THEN 'FAILED' ELSE 'PASSED' END FROM n, b""",
)
def q11_stream(spark, sf):
    """What the suite of the last batch found."""
    from ..streaming import volume

    results = volume.check_results(spark, volume_run(spark, sf, "volume-checks"))
    return results.where(F.col("batch") == results.agg(F.max("batch")).scalar())


@bind(
    "q13_share_anomaly",
    "value:s cnt:i share:r6",
    """SELECT source AS value, count(*) AS cnt, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) AS share
      FROM documents GROUP BY 1 HAVING CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) > 0.045""",
)
def q13(spark, sf):
    return Q.share_anomaly(table(spark, sf, "documents"), "source", 0.045)


@bind(
    "q14_evaluate",
    "name:s threshold:s measured:d status:s",
    """SELECT CAST(event_id AS VARCHAR) AS name, t AS threshold, value AS measured, CASE
        WHEN (t = '>400' AND value > 400) OR (t = '>=100' AND value >= 100) OR (t = '<5' AND value < 5) OR (t = '<=50%' AND value <= 0.5)
          OR (t = '!=0' AND value <> 0) OR (t = '=3.75' AND value = 3.75) THEN 'FAILED'
        WHEN t = 'large' THEN 'SKIPPED' ELSE 'PASSED' END AS status
      FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN '>400' WHEN 1 THEN '>=100' WHEN 2 THEN '<5' WHEN 3 THEN '<=50%'
        WHEN 4 THEN '=3.75' WHEN 5 THEN '!=0' ELSE 'large' END AS t FROM events)""",
)
def q14(spark, sf):
    kinds = F.array(*[F.lit(t) for t in (">400", ">=100", "<5", "<=50%", "=3.75", "!=0", "large")])
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("name"),
        F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("threshold"),
        F.col("value").alias("measured"),
        F.lit(None).cast("string").alias("message"),
    )
    return Q.evaluate(rows)


ALL_CHECKS = " UNION ALL ".join([Q2, Q3, Q5, Q9, Q10, Q11, Q4, Q8, Q1, Q6, Q7])
ERROR_ROW = "SELECT 'boundary' AS category, 'broken' AS name, 15 AS weight, CAST(NULL AS DOUBLE) AS measured, '>0' AS threshold, 'FAILED' AS status"


@bind("q18_run_suite", MEASURED, f"{ALL_CHECKS} UNION ALL {ERROR_ROW}")
def q18(spark, sf):
    broken = Q.Check("boundary", "broken", "orders", Q.blanks("no_such_column"))
    return Q.run_suite(sources(spark, sf), order_checks() + item_checks() + table_checks() + [broken])


def full_suite(spark, sf):
    return Q.suite(sources(spark, sf), order_checks() + item_checks() + table_checks())


@bind(
    "q15_health_score",
    "score:i band:s",
    f"""SELECT score, CASE WHEN score >= 90 THEN 'green' WHEN score >= 70 THEN 'yellow' ELSE 'red' END AS band FROM
      (SELECT greatest(0, 100 - coalesce(sum(weight) FILTER (WHERE status = 'FAILED'), 0)) AS score FROM ({ALL_CHECKS}))""",
)
def q15(spark, sf):
    return Q.score(full_suite(spark, sf))


@bind(
    "q15_health_score_orders",
    "score:i band:s",
    f"""SELECT score, CASE WHEN score >= 90 THEN 'green' WHEN score >= 70 THEN 'yellow' ELSE 'red' END AS band FROM
      (SELECT greatest(0, 100 - coalesce(sum(weight) FILTER (WHERE status = 'FAILED'), 0)) AS score
       FROM ({" UNION ALL ".join([Q2, Q3, Q5, Q9, Q10, Q11])}))""",
)
def q15o(spark, sf):
    return Q.score(Q.suite({"orders": orders(spark, sf)}, order_checks()))


@bind(
    "q16_summary",
    "total:i passed:i failed:i pass_rate:i severe:i",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASSED') AS passed, count(*) FILTER (WHERE status = 'FAILED') AS failed,
      count(*) FILTER (WHERE status = 'PASSED') * 100 // count(*) AS pass_rate,
      count(*) FILTER (WHERE status = 'FAILED' AND weight >= 30) AS severe FROM ({ALL_CHECKS})""",
)
def q16(spark, sf):
    return Q.summary(full_suite(spark, sf))


@bind(
    "q17_hints",
    "name:s status:s hint:s",
    f"""SELECT name, status, CASE WHEN status <> 'FAILED' THEN '-' WHEN category = 'uniqueness' THEN '{Q.HINTS[0][1]}'
      WHEN category = 'refutation' THEN '{Q.HINTS[1][1]}' WHEN category = 'timeliness' THEN '{Q.HINTS[2][1]}'
      WHEN category = 'consistency' THEN '{Q.HINTS[3][1]}' ELSE '{Q.DEFAULT_HINT}' END AS hint FROM ({ALL_CHECKS})""",
)
def q17(spark, sf):
    return Q.hints(full_suite(spark, sf))


@bind("t5_failures_first", "category:s name:s status:s", f"SELECT category, name, status FROM ({ALL_CHECKS})")
def t5(spark, sf):
    return failures_first(full_suite(spark, sf))


@bind(
    "q19_table_roles",
    "table_name:s role:s scripts:i",
    rf"""SELECT t AS table_name, CASE WHEN regexp_matches(t, 'ads|dm|results') THEN 'target' ELSE 'upstream' END AS role, count(*) AS scripts FROM
      (SELECT script_id, lower(unnest(regexp_extract_all(sql_text, '(?i)\bjoin\s+(\w+\.\w+)', 1))) AS t FROM {SCRIPTS}) GROUP BY 1""",
)
def q19(spark, sf):
    joined = F.regexp_extract_all("sql_text", F.lit(r"(?i)\bjoin\s+(\w+\.\w+)"), 1)
    used = scripts(spark, sf).select(F.explode(joined).alias("table_name"))
    counted = used.groupBy(F.lower("table_name").alias("table_name")).agg(F.count(F.lit(1)).alias("scripts"))
    return Q.table_roles(counted)


CHECK_FILE = """
-- [唯一性-item line] one row per order line
-- 权重: High
select order_id, line_no, count(*) as cnt
from {items}
group by order_id, line_no
having cnt > 1;
-- 预期: 0 条

-- [业务反证-cancelled] no cancelled order above the limit
-- 阈值: >100
select order_id, pay_amount
from {orders}
where order_status = '50' and pay_amount > 490000;

-- [boundary-broken] names a column that does not exist
-- weight: Low
select no_such_column from {orders};

-- [唯一性-of the day] one row per order on the run date
select order_id, count(*) as cnt
from {doubled}
where inc_day = '$[time(yyyyMMdd,-1d)]'
group by order_id
having cnt > 1;
-- 预期: 0 条

-- [时效性-newest day] the newest order is of the run date
-- 权重: High
select max(inc_day) as max_day
from {orders};
-- 预期: max_day = '$[time(yyyyMMdd,-1d)]'

-- [波动-daily orders] change of the order count from day to day
-- 权重: Low
select inc_day, count(*) as cnt,
    round((count(*) - lag(count(*)) over(order by inc_day)) * 100.0 / lag(count(*)) over(order by inc_day), 2) as pct_change
from {orders}
where inc_day >= '$[time(yyyyMMdd,-30d)]' and inc_day <= '${bizdate}'
group by inc_day;
-- 预期: pct_change 在 ±30% 以内

-- [boundary-macro] a macro that nobody knows
-- weight: Low
select order_id from {orders} where inc_day = '$[quarter(yyyyMMdd)]';
"""


@bind(
    "q20_sql_checks",
    MEASURED,
    f"""{one("唯一性", "item line", f"SELECT count(*) FROM (SELECT 1 FROM {ITEMS} GROUP BY order_id, line_no HAVING count(*) > 1)", 30, ">0", "m > 0")}
      UNION ALL {one("业务反证", "cancelled", f"SELECT count(*) FROM {ORDERS} WHERE order_status = '50' AND pay_amount > 490000", 15, ">100", "m > 100")}
      UNION ALL SELECT 'boundary', 'broken', 5, NULL, '>0', 'FAILED' UNION ALL SELECT 'boundary', 'macro', 5, NULL, '>0', 'FAILED'
      UNION ALL {one("唯一性", "of the day", f"SELECT count(DISTINCT order_id) FROM {ORDERS} WHERE inc_day = '{BIZDATE}'", 15, ">0", "m > 0")}
      UNION ALL {one("时效性", "newest day", f"SELECT CASE WHEN max(inc_day) = '{BIZDATE}' THEN 0 ELSE 1 END FROM {ORDERS}", 30, ">0", "m > 0")}
      UNION ALL {one("波动", "daily orders", f"SELECT count(*) FROM (SELECT inc_day, n, lag(n) OVER (ORDER BY inc_day) AS p FROM (SELECT inc_day, count(*) AS n FROM {ORDERS} WHERE inc_day BETWEEN '19980517' AND '{BIZDATE}' GROUP BY 1)) WHERE abs(round((n - p) * 100.0 / p, 2)) > 30", 5, ">0", "m > 0")}""",
)
def q20(spark, sf):
    o = orders(spark, sf)
    tables = {"orders": o, "items": items(spark, sf), "doubled": o.unionAll(o)}
    return Q.run_sql_checks(spark, tables, CHECK_FILE, BIZDATE)


REGISTERED_FILE = """
-- [metric-revenue] paid revenue of the run date
-- weight: High
select revenue_gap('${bizdate}') as gap from (select 1) where revenue_gap('${bizdate}') > 0.5;

-- [metric-share] paid share of every priority
select priority, paid_share(priority) as share from (select distinct priority from all_orders) where paid_share(priority) < 0.2;

-- [rule-amounts] orders of a status above a limit
-- weight: Low
select * from orders_above('50', 490000);
"""
PAID_OF = "order_status IN ('20', '30', '40')"


@bind(
    "q20_registered_checks",
    MEASURED,
    f"""WITH r AS (SELECT sum(pay_amount) FILTER (WHERE inc_day = '{BIZDATE}') AS a, sum(pay_amount) FILTER (WHERE inc_day = '19980615') AS b FROM {ORDERS} WHERE {PAID_OF}),
      p AS (SELECT priority FROM {ORDERS} GROUP BY 1 HAVING count(*) FILTER (WHERE {PAID_OF}) / CAST(count(*) AS DOUBLE) < 0.2)
      {one("metric", "revenue", "SELECT CASE WHEN abs(CAST(a - b AS DOUBLE)) / CAST(b AS DOUBLE) > 0.5 THEN 1 ELSE 0 END FROM r", 30, ">0", "m > 0")}
      UNION ALL {one("metric", "share", "SELECT count(*) FROM p", 15, ">0", "m > 0")}
      UNION ALL {one("rule", "amounts", f"SELECT count(*) FROM {ORDERS} WHERE order_status = '50' AND pay_amount > 490000", 5, ">0", "m > 0")}""",
)
def q20_registered(spark, sf):
    """A check file that calls registered metrics, a function and a table of offending rows."""
    from ..plans.registry import Registry

    known = Registry()
    known.function("relative_gap", "a DOUBLE, b DOUBLE", "DOUBLE", "abs(try_divide(a - b, b))")
    known.metric("paid_revenue", "all_orders", "sum(pay_amount)", f"{PAID_OF} AND inc_day = paid_revenue.day", "day STRING")
    known.metric("paid_share", "all_orders", f"avg(CASE WHEN {PAID_OF} THEN 1.0 ELSE 0.0 END)", "priority = paid_share.name", "name STRING")
    known.function("revenue_gap", "day STRING", "DOUBLE", "relative_gap(paid_revenue(day), paid_revenue('19980615'))")
    known.check("orders_above", "status STRING, bound INT", "SELECT order_id, pay_amount FROM all_orders WHERE order_status = orders_above.status AND pay_amount > orders_above.bound")
    return known.run_checks(spark, {"all_orders": orders(spark, sf)}, REGISTERED_FILE, BIZDATE)


# --- contracts ----------------------------------------------------------------------


@bind(
    "c2_missing_fields",
    "field:s",
    rf"""SELECT DISTINCT lower(unnest(regexp_extract_all(regexp_extract(sql_text, '(?is)insert overwrite table .*?\bselect\s+(.*?)\s+from\b', 1), '(?i)\b[a-z_]\w*\.[a-z_]\w*\s+as\s+(\w+)', 1))) AS field
      FROM {SCRIPTS} EXCEPT SELECT unnest(['order_id','customer_id','order_status','pay_amount','order_time','priority','inc_day'])""",
)
def c2(spark, sf):
    fields = column_lineage(scripts(spark, sf)).select(F.col("target_field").alias("field"))
    return C.missing_fields(fields, orders(spark, sf).schema)


@bind(
    "c3_missing_outputs",
    "table_name:s severity:s",
    rf"""WITH used AS (SELECT DISTINCT lower(unnest(regexp_extract_all(sql_text, '(?i)\b(?:from|join)\s+([a-z_]\w*\.\w+)', 1))) AS t
        FROM (SELECT replace(sql_text, '''from fake.t''', '') AS sql_text FROM {SCRIPTS})),
      made AS (SELECT DISTINCT lower(unnest(regexp_extract_all(sql_text, '(?i)insert overwrite table (\w+\.\w+)', 1))) AS t FROM {SCRIPTS}
        UNION SELECT DISTINCT lower(unnest(regexp_extract_all(sql_text, '(?i)create table (\w+\.\w+)', 1))) FROM {SCRIPTS})
      SELECT t AS table_name, CASE WHEN regexp_matches(split_part(t, '.', 2), '^(dws_|dwd_|dim_)') THEN 'warning' ELSE 'critical' END AS severity
      FROM used WHERE t NOT IN (SELECT t FROM made) AND NOT starts_with(t, 'tmp_')""",
)
def c3(spark, sf):
    found = targets_and_sources(scripts(spark, sf))
    used = found.select(F.explode_outer("sources").alias("table_name")).where("table_name IS NOT NULL")
    made = found.select(F.explode_outer("targets").alias("table_name")).where("table_name IS NOT NULL")
    return C.missing_outputs(used, made)


@bind(
    "c4_dry_run",
    "statement:s outcome:s",
    """SELECT * FROM (VALUES ('daily', 'ok'), ('lost', 'table-missing'), ('column', 'analysis-error'), ('cast', 'runtime-error')) AS v(statement, outcome)""",
)
def c4(spark, sf):
    statements = {
        "daily": "select inc_day, sum(pay_amount) as gmv from {orders} group by inc_day",
        "lost": "select a from no_such_db_table",
        "column": "select no_such_column from {orders}",
        "cast": "select max(cast(priority as int)) as n from {orders}",
    }
    return C.dry_run(spark, statements, {"orders": orders(spark, sf)})


@bind(
    "c5_idempotent",
    "state:s keys:i",
    f"SELECT 'same' AS state, count(DISTINCT inc_day) AS keys FROM {ORDERS} WHERE order_status IN ('20','30','40')",
)
def c5(spark, sf):
    return C.idempotent(lambda: commerce_daily(orders(spark, sf), "order_status IN ('20','30','40')"), ["inc_day"])
