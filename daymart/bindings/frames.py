"""The shared tables under the warehouse column names, for Spark and as SQL sub-selects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.days import day_of, ts_between_days
from ..functions.exprs import classify, money
from ..sources.tables import load, read_files

BIZDATE = "19980615"
EVENT_BIZDATE = "20240125"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table. Its schema is read from the file once per process; each further
    read then needs no footer job."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = load(spark, sf, name).schema
    return read_files(spark, path, "parquet", _SCHEMAS[path])


def _days(df: DataFrame, ts: str, days: tuple[str, str] | None) -> DataFrame:
    """Rows of a day range, as a condition on the raw timestamp that reaches the scan."""
    return df if days is None else df.where(ts_between_days(ts, *days))


STATUS = {"50": "o_orderpriority = '5-LOW'", "20": "o_orderstatus = 'F'", "30": "o_orderstatus = 'O'"}

ORDERS = """(SELECT o_orderkey AS order_id, o_custkey AS customer_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN '50' WHEN o_orderstatus = 'F' THEN '20'
       WHEN o_orderstatus = 'O' THEN '30' ELSE '10' END AS order_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS pay_amount, o_orderdate AS order_time,
  o_orderpriority AS priority, strftime(o_orderdate, '%Y%m%d') AS inc_day FROM orders)"""


def orders(spark: SparkSession, sf: str, days: tuple[str, str] | None = None) -> DataFrame:
    return _days(table(spark, sf, "orders"), "o_orderdate", days).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        classify(STATUS, "10").alias("order_status"),
        money("o_totalprice").alias("pay_amount"),
        F.col("o_orderdate").alias("order_time"),
        F.col("o_orderpriority").alias("priority"),
        day_of("o_orderdate").alias("inc_day"),
    )


ITEMS = """(SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS supplier_id, l_linenumber AS line_no,
  CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS item_amount,
  CAST(l_discount AS DECIMAL(18,2)) AS discount, l_returnflag AS return_flag, l_linestatus AS line_status,
  strftime(l_shipdate, '%Y%m%d') AS inc_day FROM lineitem)"""


def items(spark: SparkSession, sf: str, days: tuple[str, str] | None = None) -> DataFrame:
    return _days(table(spark, sf, "lineitem"), "l_shipdate", days).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line_no"),
        money("l_quantity").alias("quantity"),
        money("l_extendedprice").alias("item_amount"),
        money("l_discount").alias("discount"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        day_of("l_shipdate").alias("inc_day"),
    )


SESSIONS = """(SELECT event_id AS session_id, user_id, ts AS login_time, CAST(value AS DECIMAL(18,2)) AS duration_seconds,
  event_type AS feature_name, strftime(ts, '%Y%m%d') AS inc_day FROM events)"""


def sessions(spark: SparkSession, sf: str, days: tuple[str, str] | None = None) -> DataFrame:
    return _days(table(spark, sf, "events"), "ts", days).select(
        F.col("event_id").alias("session_id"),
        "user_id",
        F.col("ts").alias("login_time"),
        money("value").alias("duration_seconds"),
        F.col("event_type").alias("feature_name"),
        day_of("ts").alias("inc_day"),
    )


MOVES = """(SELECT n_regionkey AS warehouse_id, p_type AS sku_id, -CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
  CASE WHEN l_returnflag = 'R' THEN 'adjustment' WHEN l_linestatus = 'O' THEN 'OUTBOUND' ELSE 'outbound' END AS movement_type,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS reference_no,
  p_size, l_linestatus, strftime(l_shipdate, '%Y%m%d') AS inc_day
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey)"""


def moves(spark: SparkSession, sf: str) -> DataFrame:
    li, su, na, pa = (table(spark, sf, n) for n in ("lineitem", "supplier", "nation", "part"))
    returned, is_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    joined = (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .join(na, su.s_nationkey == na.n_nationkey)
        .join(pa, li.l_partkey == pa.p_partkey)
    )
    return joined.select(
        F.col("n_regionkey").alias("warehouse_id"),
        F.col("p_type").alias("sku_id"),
        (-money("l_quantity")).alias("quantity"),
        F.when(returned, "adjustment").when(is_open, "OUTBOUND").otherwise("outbound").alias("movement_type"),
        F.when(~(returned & is_open), F.col("l_orderkey").cast("string")).alias("reference_no"),
        "p_size",
        "l_linestatus",
        day_of("l_shipdate").alias("inc_day"),
    )


SNAPSHOTS = f"""(SELECT warehouse_id, sku_id, inc_day, CAST(sum(p_size * 2) AS DECIMAL(18,2)) AS stock_quantity,
  CAST(sum(CASE WHEN l_linestatus = 'O' THEN -quantity ELSE 0 END) AS DECIMAL(18,2)) AS locked_quantity
  FROM {MOVES} GROUP BY ALL)"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    locked = F.when(F.col("l_linestatus") == "O", -F.col("quantity")).otherwise(0)
    return (
        moves(spark, sf)
        .groupBy("warehouse_id", "sku_id", "inc_day")
        .agg(
            F.sum(F.col("p_size") * 2).cast("decimal(18,2)").alias("stock_quantity"),
            F.sum(locked).cast("decimal(18,2)").alias("locked_quantity"),
        )
    )


SKUS = """(SELECT p_type AS sku_id, min(CAST(p_retailprice AS DECIMAL(18,2))) AS unit_cost, 50 AS safety_stock,
  100 AS reorder_point FROM part GROUP BY p_type)"""


def skus(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .groupBy(F.col("p_type").alias("sku_id"))
        .agg(F.min(money("p_retailprice")).alias("unit_cost"))
        .withColumns({"safety_stock": F.lit(50), "reorder_point": F.lit(100)})
    )


# One expression both dialects read: a script text per part, with every shape the corpus
# jobs look for. Derived from the row, so the corpus grows with the table.
SCRIPT_EXPR = " || ".join(
    [
        "(CASE WHEN p_size % 4 = 0 THEN '-- 指标: gmv_' || lower(p_type) || ': total | sum(pay_amount) | status = 1 | yuan' || chr(10)"
        " || '-- 指标: gmv_' || lower(p_type) || ': newer total | sum(net_amount)' || chr(10) ELSE '-- job for ' || p_name || chr(10) END)",
        "(CASE WHEN p_size % 7 = 0 THEN 'create table tmp_dw.tmp_' || lower(p_type) || '_s as select * from ods.ods_raw_' || lower(p_type) || ';' || chr(10)"
        " WHEN p_size % 7 = 1 THEN 'DROP TABLE if exists dw.tmp_stage;' || chr(10) ELSE '' END)",
        "'insert overwrite table ads_demo.ads_' || replace(lower(p_brand), '#', '_') || '_di'",
        "(CASE WHEN p_size % 2 = 0 THEN ' partition (inc_day = ''$[time(yyyyMMdd,-1d)]'')' || chr(10) ELSE chr(10) || 'partition (inc_day)' || chr(10) END)",
        "(CASE WHEN p_size % 5 = 0 THEN 'SELECT ' ELSE 'select ' END)",
        "'a.order_id as order_id,' || chr(10) || '  b.' || replace(lower(p_name), ' ', '_') || ' as item_name,' || chr(10)",
        "(CASE WHEN p_size % 3 = 0 THEN '  nvl(sum(a.pay_amount), 0) as pay_amount' ELSE '  sum(a.pay_amount) as pay_amount' END) || chr(10)",
        "'from dwd_demo.dwd_' || lower(p_type) || '_order_di a' || chr(10)",
        "(CASE WHEN p_size % 6 = 0 THEN 'cross join dim_demo.dim_' || replace(lower(p_name), ' ', '_') || '_df b' || chr(10)"
        " ELSE 'left join dim_demo.dim_' || replace(lower(p_name), ' ', '_') || '_df b on a.id = b.id' || chr(10) END)",
        "(CASE WHEN p_size % 11 = 0 THEN 'left join ads_demo.ads_brand_' || CAST(p_size % 25 + 1 AS VARCHAR(20)) || '_di c on a.id = nullif(c.id, 0)' || chr(10) ELSE '' END)",
        "(CASE WHEN p_size % 8 = 0 THEN '' WHEN p_size % 8 = 1 THEN 'where a.cur_date = 1' || chr(10) ELSE 'where a.inc_day = ''x'' and a.note = ''from fake.t''' || chr(10) END)",
        "(CASE WHEN p_size % 13 = 0 THEN 'union all' || chr(10) || 'select * from dwd_demo.dwd_extra_di' || chr(10) ELSE '' END)",
        "'group by a.order_id, b.name;' || chr(10)",
    ]
)
PATH_EXPR = "'jobs/' || lower(p_type) || (CASE WHEN p_size % 9 = 0 THEN '/templates/s' ELSE '/s' END) || CAST(p_partkey AS VARCHAR(20)) || '.sql'"
SCRIPTS = f"(SELECT p_partkey AS script_id, {PATH_EXPR} AS path, {SCRIPT_EXPR} AS sql_text FROM part)"


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    path, text = (e.replace("VARCHAR(20)", "STRING") for e in (PATH_EXPR, SCRIPT_EXPR))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("script_id"), F.expr(path).alias("path"), F.expr(text).alias("sql_text")
    )


# One log line per event, valid in both dialects.
LOG_EXPR = (
    "'run ' || CAST(event_id AS {text}) || ' ' || CASE event_type WHEN 'error' THEN 'x.llm WARN LLM CLI 调用超时，重试' WHEN 'click' THEN 'x.llm WARN 重试'"
    " WHEN 'view' THEN 'x.http ERROR 302 Found 重试' WHEN 'signup' THEN 'x.core WARN 连接失败，降级' ELSE 'x.core INFO ok' END"
)
LOGS = f"(SELECT user_id, strftime(ts, '%Y%m%d') AS inc_day, {LOG_EXPR.format(text='VARCHAR')} AS value FROM events)"


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id", day_of("ts").alias("inc_day"), F.expr(LOG_EXPR.format(text="STRING")).alias("value")
    )
