"""IO1-IO13: sources and sinks. Tables are made under the shared scratch folder."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import profiling
from ..operators.joins import latest_available
from ..session import StageArea
from ..sources import partitions
from ..sources import tables as io
from . import bind
from .frames import EVENT_BIZDATE, ITEMS, ORDERS, SESSIONS, items, orders, sessions, table

TOTALS = "inc_day:s sessions:i seconds:d"
BY_DAY = f"SELECT inc_day, count(*) AS sessions, sum(duration_seconds) AS seconds FROM {SESSIONS}"

SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.LongType(), metadata={"comment": "primary key"}),
        T.StructField("user_id", T.LongType(), metadata={"comment": "who was active"}),
        T.StructField("duration_seconds", T.DecimalType(18, 2), metadata={"comment": "length in seconds"}),
        T.StructField("inc_day", T.StringType(), metadata={"comment": "day partition"}),
    ]
)


def rows(spark, sf):
    return sessions(spark, sf).select(*SCHEMA.fieldNames())


def new_table(spark, tag: str) -> str:
    name = f"dwd_{tag}_{uuid.uuid4().hex[:10]}"
    io.create_table(spark, name, SCHEMA, location=StageArea(spark, tag).path(name), comment="session facts")
    return name


def by_day(df):
    return df.groupBy("inc_day").agg(F.count(F.lit(1)).alias("sessions"), F.sum("duration_seconds").alias("seconds"))


@bind("io1_partition_scan", TOTALS, f"{BY_DAY} WHERE inc_day BETWEEN '20240110' AND '20240112' GROUP BY 1")
def io1(spark, sf):
    name = new_table(spark, "scan")
    io.write_partitions(rows(spark, sf), name)
    return by_day(io.scan(spark, name, F.col("inc_day").between("20240110", "20240112")))


@bind(
    "io2_formats",
    "fmt:s rows:i amount:d",
    f"""SELECT f AS fmt, count(*) AS rows, sum(pay_amount) AS amount FROM {ORDERS}, (SELECT unnest(['parquet', 'orc', 'text']) AS f) GROUP BY 1""",
)
def io2(spark, sf):
    area = StageArea(spark, "formats")
    src = orders(spark, sf).select("order_id", "pay_amount")
    out = None
    for fmt in io.FORMATS:
        df = src if fmt != "text" else src.select(F.concat_ws("\t", "order_id", "pay_amount").alias("value"))
        io.write_files(df, area.path(fmt), fmt)
        back = io.read_files(spark, area.path(fmt), fmt)
        if fmt == "text":
            back = back.select(F.split("value", "\t")[1].cast("decimal(18,2)").alias("pay_amount"))
        part = back.agg(F.count(F.lit(1)).alias("rows"), F.sum("pay_amount").alias("amount")).withColumn("fmt", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@bind(
    "io5_sample_table",
    "order_id:i inc_day:s pay_amount:d",
    f"SELECT order_id, inc_day, pay_amount FROM {ORDERS} WHERE inc_day = (SELECT max(inc_day) FROM {ORDERS}) ORDER BY order_id LIMIT 10",
)
def io5(spark, sf):
    o = orders(spark, sf)
    newest = F.col("inc_day") == o.agg(partitions.newest_day(o)).scalar()
    return io.sample_table(o, newest, 10, ["order_id"])


@bind(
    "io6_run_sql",
    "supplier_id:i items:i amount:d",
    f"SELECT supplier_id, count(*) AS items, sum(item_amount) AS amount FROM {ITEMS} GROUP BY 1 ORDER BY amount DESC, supplier_id LIMIT 1000",
)
def io6(spark, sf):
    sql = "select supplier_id, count(*) as items, sum(item_amount) as amount from {items} group by supplier_id order by amount desc, supplier_id"
    return io.run_sql(spark, sql, {"items": items(spark, sf)}, max_rows=1000)


@bind(
    "io8_overwrite_partition",
    TOTALS,
    f"{BY_DAY} WHERE inc_day <> '{EVENT_BIZDATE}' OR duration_seconds > 100 GROUP BY 1",
)
def io8(spark, sf):
    name = new_table(spark, "static")
    src = rows(spark, sf)
    io.write_partitions(src, name)
    io.write_partition(src.where((F.col("inc_day") == EVENT_BIZDATE) & (F.col("duration_seconds") > 100)), name, EVENT_BIZDATE)
    return by_day(spark.table(name))


@bind(
    "io9_dynamic_overwrite",
    TOTALS,
    f"{BY_DAY} WHERE inc_day < '20240120' OR duration_seconds > 50 GROUP BY 1",
)
def io9(spark, sf):
    name = new_table(spark, "dynamic")
    src = rows(spark, sf)
    io.write_partitions(src, name)
    io.write_partitions(src.where("inc_day >= '20240120' AND duration_seconds > 50"), name)
    return by_day(spark.table(name))


@bind(
    "io10_append",
    TOTALS,
    f"""SELECT inc_day, sum(sessions) AS sessions, sum(seconds) AS seconds FROM ({BY_DAY} GROUP BY 1 UNION ALL
      {BY_DAY} WHERE inc_day = '{EVENT_BIZDATE}' GROUP BY 1) GROUP BY 1""",
)
def io10(spark, sf):
    name = new_table(spark, "append")
    src = rows(spark, sf)
    io.append(src, name)
    io.append(src.where(F.col("inc_day") == EVENT_BIZDATE), name)
    return by_day(spark.table(name))


@bind(
    "io11_stage_then_publish",
    "user_id:i sessions:i seconds:d",
    f"SELECT user_id, count(*) AS sessions, sum(duration_seconds) AS seconds FROM {SESSIONS} GROUP BY 1 HAVING count(*) > 50",
)
def io11(spark, sf):
    users = sessions(spark, sf).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("duration_seconds").alias("seconds")
    )
    name = f"tmp_users_{uuid.uuid4().hex[:10]}"
    staged = io.stage(users, name, StageArea(spark, "stage").path(name))
    return staged.where("sessions > 50")


@bind(
    "io12_create_table",
    "session_id:i user_id:i duration_seconds:d inc_day:s",
    f"SELECT session_id, user_id, duration_seconds, inc_day FROM {SESSIONS}",
)
def io12(spark, sf):
    name = new_table(spark, "create")
    io.write_partitions(rows(spark, sf), name)
    return spark.table(name)


@bind(
    "io13_evolve_backfill",
    "inc_day:s sessions:i long_sessions:i",
    f"""SELECT inc_day, count(*) AS sessions, CASE WHEN inc_day > '20240120' AND inc_day <= '20240130' THEN count(*) FILTER (WHERE duration_seconds > 100) ELSE 0 END AS long_sessions
      FROM {SESSIONS} GROUP BY 1""",
)
def io13(spark, sf):
    name = new_table(spark, "evolve")
    io.write_partitions(rows(spark, sf), name)
    io.evolve_and_backfill(
        spark, name, {"is_long": "int DEFAULT 0"}, lambda d: d.withColumn("is_long", (F.col("duration_seconds") > 100).cast("int")),
        "20240130", days=10,
    )
    return spark.table(name).groupBy("inc_day").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("is_long").alias("long_sessions")
    )


DESCRIBED = ("customer", "supplier", "events")


def by_day_table(spark, sf, tag):
    """Sessions as a table partitioned by day, with a registered day that holds no file."""
    name = new_table(spark, tag)
    io.write_partitions(rows(spark, sf), name)
    spark.sql(f"ALTER TABLE {name} ADD PARTITION (inc_day = '20240215')")
    return name


@bind("t1_partition_metadata", "latest_partition:s listed:i", f"SELECT max(inc_day) AS latest_partition, count(DISTINCT inc_day) AS listed FROM {SESSIONS}")
def t1_metadata(spark, sf):
    """The newest day that holds data and the number of such days, from the catalog and the file index."""
    from ..operators import topk

    t = spark.table(by_day_table(spark, sf, "newest"))
    return topk.latest_partition(t).withColumn("listed", F.lit(len(partitions.days(t))))


@bind(
    "pr1_metadata_bounded",
    "latest_partition:s rows:i",
    f"SELECT inc_day AS latest_partition, count(*) AS rows FROM {SESSIONS} WHERE inc_day = (SELECT max(inc_day) FROM {SESSIONS}) GROUP BY 1",
)
def pr1_metadata(spark, sf):
    """Searched from a year after the data, by the file index alone."""
    t = spark.table(by_day_table(spark, sf, "bounded"))
    latest = profiling.latest_partition(t, bounded=True, today=date(2025, 6, 1))
    return profiling.row_count(t.where(F.col("inc_day") == latest)).select(F.lit(latest).alias("latest_partition"), F.col("row_count").alias("rows"))


@bind(
    "j14_latest_partition_with_rows",
    "session_id:i inc_day:s duration_seconds:d",
    f"""SELECT session_id, inc_day, duration_seconds FROM {SESSIONS} WHERE inc_day = (
      SELECT max(inc_day) FROM {SESSIONS} WHERE inc_day <= '{EVENT_BIZDATE}' AND duration_seconds > 300)""",
)
def j14_partition(spark, sf):
    t = spark.table(by_day_table(spark, sf, "available"))
    return latest_available(t, EVENT_BIZDATE, cond="duration_seconds > 300")


@bind(
    "pr2_row_count_partition",
    "row_count:i",
    f"SELECT count(*) AS row_count FROM {SESSIONS} WHERE inc_day = (SELECT max(inc_day) FROM {SESSIONS} WHERE inc_day <= '20240125')",
)
def pr2_partition(spark, sf):
    return profiling.row_count(latest_available(spark.table(by_day_table(spark, sf, "rowcount")), "20240125"))


@bind(
    "io5_sample_partition",
    "session_id:i inc_day:s",
    f"SELECT session_id, inc_day FROM {SESSIONS} WHERE inc_day = (SELECT max(inc_day) FROM {SESSIONS}) ORDER BY session_id LIMIT 10",
)
def io5_partition(spark, sf):
    t = spark.table(by_day_table(spark, sf, "sample"))
    return io.sample_table(t, F.col("inc_day") == partitions.days(t)[0], 10, ["session_id"])


@bind(
    "io1_scan_report",
    "query:s partitions:i files:b partition_filters:b",
    f"""SELECT q AS query, count(DISTINCT inc_day) AS partitions, true AS files, q <> 'all' AS partition_filters
      FROM {SESSIONS}, (SELECT unnest(['all', 'week', 'day']) AS q)
      WHERE q = 'all' OR q = 'week' AND inc_day BETWEEN '20240108' AND '20240114' OR q = 'day' AND inc_day = '20240110' GROUP BY q""",
)
def io1_report(spark, sf):
    """Partitions that three scans select, from their plans."""
    name = new_table(spark, "report")
    io.write_partitions(rows(spark, sf), name)
    day = F.col("inc_day")
    wanted = {"all": F.lit(True), "week": day.between("20240108", "20240114"), "day": day == "20240110"}
    out = None
    for query, pred in wanted.items():
        part = partitions.scan_report(io.scan(spark, name, pred)).select(
            F.lit(query).alias("query"), "partitions", (F.col("files") >= F.col("partitions")).alias("files"), (F.col("partition_filters") > 0).alias("partition_filters")
        )
        out = part if out is None else out.unionByName(part)
    return out


@bind(
    "io3_describe_table",
    "table_name:s column:s type:s is_partition:b filled:i",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, c.column_name AS "column",
          CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'INTEGER' THEN 'int' WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type,
          c.column_name IN ('c_mktsegment', 's_nationkey', 'event_type') AS is_partition, filled
        FROM (DESCRIBE SELECT * FROM {t}) c JOIN (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE filled) f ON c.column_name = f.column_name"""
        for t in DESCRIBED
    ),
)
def io3(spark, sf):
    """The catalog's columns of three written tables, each with the values that the table holds."""
    out = None
    for t, part in zip(DESCRIBED, ("c_mktsegment", "s_nationkey", "event_type")):
        name = f"dwd_{t}_{uuid.uuid4().hex[:10]}"
        table(spark, sf, t).write.partitionBy(part).option("path", StageArea(spark, "describe").path(name)).saveAsTable(name)
        described = io.describe_table(spark, name)
        held = spark.table(name)
        counts = held.agg(*[F.count(c).alias(c) for c in held.columns]).first().asDict()
        spark.sql(f"DROP TABLE {name}")
        filled = spark.createDataFrame(list(counts.items()), "column string, filled bigint")
        one = described.join(filled, "column").select(F.lit(t).alias("table_name"), "column", "type", "is_partition", "filled")
        out = one if out is None else out.unionByName(one)
    return out


@bind(
    "io4_list_tables",
    "table_name:s comment:s nations:i",
    """SELECT 'dim_' || lower(replace(r_name, ' ', '_')) AS table_name, 'nations of ' || r_name AS comment, count(n_nationkey) AS nations
      FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def io4(spark, sf):
    """One table per region, found again by a word of its name or comment."""
    tag = uuid.uuid4().hex[:10]
    nations = table(spark, sf, "nation")
    for r in table(spark, sf, "region").collect():
        name = f"dim_{r.r_name.lower().replace(' ', '_')}_{tag}"
        path = StageArea(spark, "list").path(name)
        nations.where(F.col("n_regionkey") == r.r_regionkey).write.option("path", path).saveAsTable(name)
        spark.sql(f"COMMENT ON TABLE {name} IS 'nations of {r.r_name}'")
    found = [r for r in io.list_tables(spark, "default", "nations of ").collect() if r.table_name.endswith(tag)]
    found = [(r.table_name.removesuffix(f"_{tag}"), r.comment, spark.table(r.table_name).count()) for r in found]
    for r in io.list_tables(spark, "default", tag).collect():
        spark.sql(f"DROP TABLE {r.table_name}")
    return spark.createDataFrame(found, "table_name string, comment string, nations bigint")


@bind(
    "io7_scan_corpus",
    "item_id:i kind:s chars:i",
    "SELECT item_id, 'txt' AS kind, length(text) + 1 AS chars FROM benchmark",
)
def io7(spark, sf):
    root = StageArea(spark, "corpus").path("files")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(root)
    docs = io.scan_corpus(spark, root, ["txt"])
    return docs.select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "kind", F.length("text").alias("chars")
    )


@bind(
    "c6_partition_pruning",
    "query:s sessions:i unpruned_scans:i partitions:i over_limit:b",
    f"""SELECT 'day' AS query, count(*) AS sessions, 0 AS unpruned_scans, count(DISTINCT inc_day) AS partitions, count(DISTINCT inc_day) > 20 AS over_limit
      FROM {SESSIONS} WHERE inc_day BETWEEN '20240110' AND '20240112'
      UNION ALL SELECT 'all', count(*), 1, count(DISTINCT inc_day), count(DISTINCT inc_day) > 20 FROM {SESSIONS}""",
)
def c6(spark, sf):
    from ..operators import contracts

    name = new_table(spark, "prune")
    io.write_partitions(rows(spark, sf), name)
    scans = {"day": io.scan(spark, name, F.col("inc_day").between("20240110", "20240112")), "all": spark.table(name)}
    out = None
    for query, df in scans.items():
        part = contracts.scanned_partitions(df, "inc_day", 20)
        part = part.withColumn("sessions", df.agg(F.count(F.lit(1))).scalar()).withColumns({"query": F.lit(query), "unpruned_scans": F.lit(contracts.unpruned_scans(df))})
        out = part if out is None else out.unionByName(part)
    return out


@bind(
    "c1_contract_checked_write",
    "inc_day:s sessions:i issues:i",
    f"SELECT inc_day, count(*) AS sessions, 2 AS issues FROM {SESSIONS} GROUP BY 1",
)
def c1(spark, sf):
    from ..operators import contracts

    good = rows(spark, sf)
    # two columns swapped: two names out of place
    swapped = good.select("user_id", "session_id", "duration_seconds", "inc_day")
    issues = contracts.check_contract(swapped, SCHEMA, ["inc_day"], dynamic=True)
    if not contracts.check_contract(good, SCHEMA, ["inc_day"], dynamic=True).isEmpty():
        raise ValueError("the output does not match its target")
    name = new_table(spark, "contract")
    io.write_partitions(good, name)
    written = spark.table(name).groupBy("inc_day").agg(F.count(F.lit(1)).alias("sessions"))
    return written.withColumn("issues", issues.agg(F.count(F.lit(1))).scalar())
