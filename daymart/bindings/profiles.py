"""PR1-PR8: profiling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import profiling as P
from . import bind
from .frames import BIZDATE, ITEMS, ORDERS, items, orders, table


def _profile_sql(source: str, cols: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {extra}'{c}' AS "column", count(*) AS row_count, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS distinct_count,
        CASE WHEN count(DISTINCT {c}) = count(*) AND count(*) > 0 THEN 'unique' ELSE 'has duplicates' END AS note FROM {source}"""
        for c in cols
    )


def _enum_sql(source: str, cols: list[str], n: int = 10) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS cnt,
        row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) NULLS LAST) AS rank FROM {source} GROUP BY {c}) WHERE rank <= {n}"""
        for c in cols
    )


@bind(
    "pr1_latest_partition_bounded",
    "latest_partition:s rows:i",
    f"""SELECT max(inc_day) AS latest_partition, count(*) AS rows FROM {ORDERS}
      WHERE inc_day = (SELECT max(inc_day) FROM {ORDERS} WHERE inc_day >= '20010101' AND inc_day < '20020101')""",
)
def pr1(spark, sf):
    o = orders(spark, sf)
    latest = P.latest_partition(o, bounded=True, today=date(2002, 3, 1))
    return o.where(F.col("inc_day") == latest).agg(F.max("inc_day").alias("latest_partition"), F.count(F.lit(1)).alias("rows"))


@bind(
    "pr2_row_count",
    "row_count:i",
    f"SELECT count(*) AS row_count FROM {ITEMS} WHERE inc_day = (SELECT max(inc_day) FROM {ITEMS} WHERE inc_day <= '{BIZDATE}')",
)
def pr2(spark, sf):
    from ..operators.joins import latest_available

    return P.row_count(latest_available(items(spark, sf), BIZDATE))


ENUMS = ["event_type", "props"]


@bind("pr3_enum_distribution", "column:s value:s cnt:i rank:i", _enum_sql("events", ENUMS))
def pr3(spark, sf):
    return P.profile_enums(table(spark, sf, "events"), ENUMS)


LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]
PROFILE = "column:s row_count:i null_count:i distinct_count:i note:s"


@bind("pr4_profile_columns", PROFILE, _profile_sql("lineitem", LINE_COLS))
def pr4(spark, sf):
    return P.profile_columns(table(spark, sf, "lineitem"), LINE_COLS)


@bind(
    "pr5_uniqueness_with_nulls",
    PROFILE,
    _profile_sql("(SELECT o_orderkey, c_name, c_acctbal, o_orderpriority FROM orders FULL JOIN customer ON o_orderkey = c_custkey)",
                 ["o_orderkey", "c_name", "c_acctbal", "o_orderpriority"]),
)
def pr5(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = o.join(c, o.o_orderkey == c.c_custkey, "full")
    return P.profile_columns(joined, ["o_orderkey", "c_name", "c_acctbal", "o_orderpriority"])


@bind("pr6_chosen_columns", PROFILE, _profile_sql("events", ["event_type", "event_id", "user_id"]))
def pr6(spark, sf):
    df = table(spark, sf, "events")
    choice = P.choose_columns(df.schema, "counts per event_type and day")
    return P.profile_columns(df, choice.profile)


@bind(
    "pr6_chosen_enums",
    "column:s value:s cnt:i rank:i",
    _enum_sql("documents", ["source", "lang"]),
)
def pr6e(spark, sf):
    df = table(spark, sf, "documents")
    choice = P.choose_columns(df.schema, "which source and lang, by n_chars")
    return P.profile_enums(df, choice.enums)


@bind(
    "pr7_profile_tables",
    "table_name:s column:s row_count:i null_count:i distinct_count:i note:s error:s",
    "SELECT *, CAST(NULL AS VARCHAR) AS error FROM ("
    + _profile_sql("documents", ["doc_id"], "'documents' AS table_name, ")
    + " UNION ALL " + _profile_sql("conversations", ["conv_id"], "'conversations' AS table_name, ")
    + " UNION ALL " + _profile_sql("labels", ["doc_id", "quality", "toxic"], "'labels' AS table_name, ")
    + ") UNION ALL SELECT 'lost', NULL, NULL, NULL, NULL, NULL, 'FileNotFoundError'"
    + " UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, 'CAST_INVALID_INPUT'",
)
def pr7(spark, sf):
    tables = {n: table(spark, sf, n) for n in ("documents", "conversations", "labels")}
    tables["lost"] = FileNotFoundError("no such table")
    # fails while it runs: a language is no number
    tables["broken"] = table(spark, sf, "documents").select(F.col("lang").cast("int").alias("lang_id"))
    return P.profile_tables(tables, columns={"labels": ["doc_id", "quality", "toxic"]})


@bind(
    "pr8_key_candidates",
    "column:s row_count:i distinct_count:i verified:b",
    """SELECT 'event_id' AS "column", count(*) AS row_count, count(DISTINCT event_id) AS distinct_count,
      count(DISTINCT event_id) = count(*) AS verified FROM events""",
)
def pr8(spark, sf):
    return P.key_candidates(table(spark, sf, "events"))


@bind(
    "pr8_key_from_comment",
    "column:s row_count:i distinct_count:i verified:b",
    """SELECT 'l_linenumber' AS "column", count(*) AS row_count, count(DISTINCT l_linenumber) AS distinct_count,
      count(DISTINCT l_linenumber) = count(*) AS verified FROM lineitem""",
)
def pr8c(spark, sf):
    return P.key_candidates(table(spark, sf, "lineitem"), {"l_linenumber": "primary key of the line"})
